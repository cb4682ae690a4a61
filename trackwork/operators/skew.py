"""Ordered operators that hold up when one key owns a large share of all rows.

A window sorts each of its groups in one task. That is the best plan while groups
are small, so every operator here keeps it for them; groups beyond ``HOT_ROWS`` are
found with a pre-aggregated count and take another way to the same answer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackwork.functions.noise import hash_int

HOT_ROWS = 5_000_000
EXPAND_STEP = 65_536


def same(left: DataFrame, right: DataFrame, names) -> Column:
    """Null-safe equality of ``left.name`` and ``right._r_name`` for every name."""
    return reduce(
        lambda a, b: a & b, (left[n].eqNullSafe(right[f"_r_{n}"]) for n in names)
    )


def aside(df: DataFrame, names) -> DataFrame:
    """Rename key columns so that they can be compared with another frame's."""
    return df.withColumnsRenamed({n: f"_r_{n}" for n in names})


def hot_groups(df: DataFrame, keys, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows: at most ``rows / hot_rows`` of them.

    That bound is what allows this frame, and only this one, to be broadcast.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return aside(counts.where(F.col("_rows") > hot_rows).select(*keys), keys)


def split_hot(
    df: DataFrame, keys, hot_rows: int = HOT_ROWS, census: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary groups, and rows of hot groups.

    Both sides read one broadcast; where it is empty, adaptive execution drops the second.
    ``census`` is a cheaper frame to count the keys in, such as the input before any parsing.
    """
    hot = F.broadcast(hot_groups(df if census is None else census, keys, hot_rows))
    condition = same(df, hot, keys)
    return df.join(hot, condition, "left_anti"), df.join(hot, condition, "left_semi")


def expand(df: DataFrame, copies: str, index: str) -> DataFrame:
    """One row per copy, numbered from 0, without one task writing all copies of a row."""
    start = F.sequence(F.lit(0).cast("long"), F.col(copies) - 1, F.lit(EXPAND_STEP).cast("long"))
    chunks = df.withColumn("_chunk", F.explode(start))
    chunks = chunks.repartition(*(F.col(c) for c in chunks.columns))
    last = F.least(F.col(copies) - F.col("_chunk"), F.lit(EXPAND_STEP)) - 1
    within = F.explode(F.sequence(F.lit(0).cast("long"), last))
    return (
        chunks.withColumn("_within", within)
        .withColumn(index, F.col("_chunk") + F.col("_within"))
        .drop("_chunk", "_within")
    )


def number_rows(
    df: DataFrame,
    key: str,
    order: list[str],
    levels: list[str],
    position: str = "position",
    size: str | None = None,
    first: str | None = None,
    hot_rows: int = HOT_ROWS,
    census: DataFrame | None = None,
) -> DataFrame:
    """0-based position of each row within its key, optionally with size and first value.

    ``order[0]`` sorts first and must not be null. Sorting by ``levels`` must agree with
    sorting by ``order``; a hot key is cut level by level, and each piece is placed by the
    running count of the pieces before it, so that a task orders the distinct values of one
    level at most. Rows equal in every column are interchangeable and travel as one row with
    a count.
    """
    columns = [c for c in df.columns if c in order or c not in levels]
    sorting = [F.col(c).asc_nulls_first() for c in order]
    # A key cannot have more rows than the table; where that is few, the plan has no hot branch.
    counted = df if census is None else census
    some_hot = counted.count() > hot_rows
    ordinary, hot = split_hot(df, [key], hot_rows, census) if some_hot else (df, None)

    whole = Window.partitionBy(key)
    extras = {}
    if size:
        extras[size] = F.count(F.lit(1)).over(whole)
    if first:
        extras[first] = F.min(order[0]).over(whole)
    ordinary = ordinary.withColumns(
        {position: (F.row_number().over(whole.orderBy(*sorting)) - 1).cast("long"), **extras}
    ).select(*columns, position, *extras)
    if not some_hot:
        return ordinary

    copies = hot.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_copies"))
    start = _level_starts(copies, key, order[0], levels)
    within = (
        Window.partitionBy(key, *levels)
        .orderBy(*sorting, *(F.col(c).asc_nulls_first() for c in columns if c not in order))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = copies.join(start, same(copies, start, [key, *levels]), "inner").withColumn(
        "_start", F.col("_before") + F.coalesce(F.sum("_copies").over(within), F.lit(0))
    )
    placed = expand(placed, "_copies", "_i").withColumn(position, F.col("_start") + F.col("_i"))
    names = {size: "_size", first: "_first"}
    extras = [F.col(names[c]).alias(c) for c in (size, first) if c]
    return ordinary.unionByName(
        placed.select(*columns, position, *extras)
    )


def _level_starts(copies: DataFrame, key: str, lead: str, levels: list[str]) -> DataFrame:
    """Rows of the key before each piece, with the key's size and first value."""
    start = None
    for depth, level in enumerate(levels):
        prefix = [key, *levels[:depth]]
        group = Window.partitionBy(*prefix)
        earlier = group.orderBy(F.col(level).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
        pieces = copies.groupBy(*prefix, level).agg(F.sum("_copies").alias("_n"), F.min(lead).alias("_low"))
        before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
        if start is None:
            pieces = pieces.select(
                *prefix,
                level,
                before.alias("_before"),
                F.sum("_n").over(group).alias("_size"),
                F.min("_low").over(group).alias("_first"),
            )
        else:
            pieces = pieces.withColumn("_more", before).join(start, same(pieces, start, prefix), "inner")
            pieces = pieces.select(
                *prefix, level, (F.col("_before") + F.col("_more")).alias("_before"), "_size", "_first"
            )
        start = aside(pieces, [*prefix, level])
    return start


def smallest_by_hash(df: DataFrame, key: Column, caps: list[tuple[Column, int]], bin_bits: int = 20) -> DataFrame:
    """For each (condition, cap), the ``cap`` matching rows with the smallest key hash.

    A sample of fixed size that repeats itself. A row belongs to the first condition it
    meets. Bin counts locate the bin where a cap falls; later bins never leave the scan. Each
    bin kept starts below its cap, so the caps bound how many there are to broadcast.
    """
    columns = df.columns
    strata = [F.when(condition, F.lit(i)) for i, (condition, _) in enumerate(caps)]
    tagged = df.withColumns({"_stratum": F.coalesce(*strata), "_hash": hash_int(key)})
    tagged = tagged.where(F.col("_stratum").isNotNull()).withColumn(
        "_bin", F.shiftright("_hash", 32 - bin_bits)
    )
    bins = tagged.groupBy("_stratum", "_bin").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_stratum").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    room = F.get(F.array(*(F.lit(cap) for _, cap in caps)), F.col("_stratum"))
    bins = bins.select(
        "_stratum", "_bin", (room - F.coalesce(F.sum("_n").over(upto), F.lit(0))).alias("_room")
    )
    kept = tagged.join(F.broadcast(bins.where(F.col("_room") > 0)), ["_stratum", "_bin"], "inner")
    copies = kept.groupBy(*kept.columns).agg(F.count(F.lit(1)).alias("_copies"))
    taken = (
        Window.partitionBy("_stratum", "_bin")
        .orderBy("_hash", *(F.col(c).asc_nulls_first() for c in columns))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    left = F.col("_room") - F.coalesce(F.sum("_copies").over(taken), F.lit(0))
    copies = copies.withColumn("_take", F.least("_copies", left)).where(F.col("_take") > 0)
    return copies.withColumn("_i", F.explode(F.sequence(F.lit(1), "_take"))).select(*columns)


def exact_percentiles(
    df: DataFrame, column: str, probabilities: dict[str, float], low: float, high: float, bins: int = 1 << 20
) -> DataFrame:
    """Interpolated percentiles of a column as one row, named by ``probabilities``.

    A histogram over ``[low, high]`` (values outside it fall in the end bins) finds the bins that
    hold the wanted ranks. Rows never move to be counted; a second scan takes those bins alone.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("_v"))
    values = values.withColumn("_bin", F.width_bucket("_v", F.lit(low), F.lit(high), F.lit(bins)))
    counts = values.groupBy("_bin").agg(F.count(F.lit(1)).alias("_bin_n"))
    upto = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    counts = counts.withColumns(
        {
            "_before": F.coalesce(F.sum("_bin_n").over(upto), F.lit(0)),
            "_total": F.sum("_bin_n").over(everything),
        }
    )

    def ranks(p: float) -> tuple[Column, Column]:
        place = (F.col("_total") - 1) * F.lit(p)
        return F.floor(place), F.ceil(place)

    wanted = [r for p in probabilities.values() for r in ranks(p)]
    holds = reduce(
        lambda a, b: a | b,
        ((F.col("_before") <= r) & (r < F.col("_before") + F.col("_bin_n")) for r in wanted),
    )
    chosen = F.broadcast(counts.where(holds))  # at most two bins per probability
    order = Window.partitionBy("_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    few = values.join(chosen, "_bin").groupBy("_bin", "_before", "_total", "_v").agg(F.count(F.lit(1)).alias("_n"))
    ordered = few.withColumn(
        "_from", F.col("_before") + F.coalesce(F.sum("_n").over(order), F.lit(0))
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_from") <= rank) & (rank < F.col("_from") + F.col("_n")), F.col("_v")))

    out = []
    for name, p in probabilities.items():
        lower, upper = ranks(p)
        share = F.max((F.col("_total") - 1) * F.lit(p) - lower)
        out.append((at(lower) * (1 - share) + at(upper) * share).alias(name))
    return ordered.agg(*out)


def top_per_group(df: DataFrame, keys, order, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; Spark trims every task to ``k`` before shuffling."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)
