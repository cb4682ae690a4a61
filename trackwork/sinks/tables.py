"""Parquet tables: overwrite, partitioned and clustered layouts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwork.operators.skew import HOT_ROWS, split_hot


def write_table(
    df: DataFrame,
    path: str,
    partition_by: tuple[str, ...] = (),
    repartition: tuple[int | None, str] | None = None,
) -> DataFrame:
    """Replace the table at a path, schema included, and return it read back.

    ``repartition`` deals rows by a key into so many files; without a number, files are sized by
    the data and a key too large for one is split.

    Partition values are brought together before the write, so that each one gets few files;
    adaptive execution splits a value too large for one task.
    """
    if repartition:
        n, key = repartition
        df = df.repartition(n, key) if n else df.hint("rebalance", key)
    elif partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


def cluster_write(
    df: DataFrame, path: str, keys: list[str], n: int | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Sort rows by key over the files, so that a lookup skips most files and row groups.

    A key with more than ``hot_rows`` rows fills files of its own from many tasks.
    """
    ordinary, hot = split_hot(df, keys, hot_rows)
    ranged = ordinary.repartitionByRange(n, *keys) if n else ordinary.repartitionByRange(*keys)
    spread = hot.select(*df.columns).hint("rebalance")
    laid_out = ranged.sortWithinPartitions(*keys).unionByName(spread.sortWithinPartitions(*keys))
    laid_out.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _rank(column: Column, cuts: list) -> Column:
    """Number of cut points that are not above the value, by halving; nulls rank lowest."""
    if not cuts:
        return F.lit(0)
    middle = len(cuts) // 2
    below, above = _rank(column, cuts[:middle]), _rank(column, cuts[middle + 1 :]) + (middle + 1)
    return F.when(column >= F.lit(cuts[middle]), above).otherwise(below)


def z_value(df: DataFrame, keys: list[str], bits: int = 6, sample: int = 20_000) -> Column:
    """Place of a row on the Z-curve of its keys: the bits of their ranks in turn, the highest first.

    Ranks are those of at most ``2**bits`` ranges of a key, cut from about ``sample`` rows (bounded, chosen by hash).
    """
    some = df.select(*keys).orderBy(F.xxhash64(*df.columns)).limit(sample).toPandas()
    total = F.lit(0).cast("long")
    for k, key in enumerate(keys):
        values = sorted(some[key].dropna())
        cuts = sorted({values[len(values) * i >> bits] for i in range(1, 1 << bits)}) if values else []
        rank = _rank(F.col(key), [getattr(c, "item", lambda c=c: c)() for c in cuts])
        # Few ranges need few bits: they are the highest ones, as those of the other keys.
        spare = bits - len(cuts).bit_length()
        for bit in range(spare, bits):
            total = total + F.shiftleft(F.shiftright(rank, bit - spare).bitwiseAND(1).cast("long"), bit * len(keys) + len(keys) - 1 - k)
    return total


def zorder_write(df: DataFrame, path: str, keys: list[str], n: int, bits: int = 6) -> DataFrame:
    """Lay rows out along the Z-curve of several keys, so that a lookup by any one of them skips most files.

    Rows of one place on the curve are told apart by their keys, then by a hash of all columns: no
    key, however frequent, has to fit into one file.
    """
    order = ["_z", *keys, "_h"]
    placed = df.withColumns({"_z": z_value(df, keys, bits), "_h": F.xxhash64(*df.columns)})
    laid_out = placed.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_z", "_h")
    laid_out.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def files_to_read(table: DataFrame, keys: list[str]) -> DataFrame:
    """For each key: its values, the files, and the mean share of files whose range of the key has a given value."""
    found = []
    named = table.withColumn("_file", F.input_file_name())
    for key in keys:
        ranges = named.groupBy("_file").agg(F.min(key).alias("low"), F.max(key).alias("high"))
        ranges = ranges.agg(F.collect_list(F.struct("low", "high")).alias("ranges")).withColumn("_all", F.lit(True))  # a pair for each file
        values = table.select(F.col(key).alias("v")).where("v is not null").distinct().withColumn("_all", F.lit(True))
        met = F.size(F.filter("ranges", lambda r: (r["low"] <= F.col("v")) & (F.col("v") <= r["high"])))
        share = F.avg(met / F.size("ranges")).alias("share")
        counted = values.join(F.broadcast(ranges), "_all").agg(F.count(F.lit(1)).alias("values"), F.max(F.size("ranges")).alias("files"), share)
        found.append(counted.select(F.lit(key).alias("key"), "values", "files", "share"))
    return reduce(DataFrame.unionByName, found)


def row_counts(**tables: DataFrame) -> DataFrame:
    """One labelled count per table."""
    counted = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def union_labelled(label: str = "label", **tables: DataFrame) -> DataFrame:
    """Rows of all tables under a label column."""
    return reduce(
        DataFrame.unionByName, [df.select(F.lit(name).alias(label), "*") for name, df in tables.items()]
    )


def smoke(spark: SparkSession, folder: str) -> DataFrame:
    """Write and read back a one-row table per layer."""
    tables = {
        layer: write_table(spark.createDataFrame([(1, f"{layer} ok")], "id int, msg string"), f"{folder}/{layer}")
        for layer in ("bronze", "silver", "gold")
    }
    return union_labelled("schema", **tables)


def register_views(views: dict[str, DataFrame]) -> None:
    """Make frames available to SQL under their names."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
