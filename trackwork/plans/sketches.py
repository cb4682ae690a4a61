"""Delay percentiles and train counts from small stored summaries that merge.

A summary per day and zone is written once; reports over any days and zones merge those and never read
the stops again. A new day's summaries are appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a quantile summary, and how far the share of rows below a result may be from the one asked for.
KLL_K, RANK_ERROR = 200, 0.02
#: Binary logarithm of the registers of a distinct count, and the relative error it may have (three deviations).
HLL_K, COUNT_ERROR = 12, 0.05


def summarise(rows: DataFrame, keys: list[str], value: str = "arrival_delay_min", counted: str = "train_no") -> DataFrame:
    """(keys, n, delays, trains) per group: rows with a value, its quantile summary, a summary of distinct ``counted``.

    Null values and nulls to count are left out; a group of nulls alone has a count of 0 and null summaries.
    """
    delay = F.col(value).cast("double")
    return rows.groupBy(*keys).agg(
        F.count(delay).alias("n"),
        F.when(F.count(delay) > 0, F.kll_sketch_agg_double(delay, KLL_K)).alias("delays"),
        F.when(F.count(counted) > 0, F.hll_sketch_agg(F.col(counted), HLL_K)).alias("trains"),
    )


def merged(summaries: DataFrame, keys: list[str]) -> DataFrame:
    """Summaries of coarser groups."""
    return summaries.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.when(F.sum("n") > 0, F.kll_merge_agg_double("delays", KLL_K)).alias("delays"),
        F.when(F.count("trains") > 0, F.hll_union_agg("trains")).alias("trains"),
    )


def report(summaries: DataFrame, keys: list[str], probabilities: dict[str, float]) -> DataFrame:
    """(keys, n, a column per probability, n_trains) as the summaries tell it."""
    point = lambda p: F.kll_sketch_get_quantile_double("delays", F.lit(p))
    points = [F.when(F.col("delays").isNotNull(), point(p)).alias(name) for name, p in probabilities.items()]
    trains = F.coalesce(F.hll_sketch_estimate("trains"), F.lit(0)).alias("n_trains")
    return summaries.select(*keys, "n", *points, trains)


def within_bounds(rows: DataFrame, told: DataFrame, key: str, probabilities: dict[str, float], value: str = "arrival_delay_min", counted: str = "train_no") -> DataFrame:
    """(key, n, a flag per probability, n_trains flag): whether what a report told holds for the rows themselves."""
    renamed = told.withColumnsRenamed({n: f"_{n}" for n in (*probabilities, "n_trains")}).drop("n")
    joined = rows.join(renamed, rows[key].eqNullSafe(renamed[key])).drop(renamed[key])
    share = lambda condition: F.avg(F.when(F.col(value).isNotNull(), condition.cast("int")))

    def holds(name: str, p: float) -> Column:
        below, upto = share(F.col(value) < F.col(f"_{name}")), share(F.col(value) <= F.col(f"_{name}"))
        return ((below <= p + RANK_ERROR) & (upto >= p - RANK_ERROR)).cast("int").alias(name)

    exact = F.countDistinct(counted)
    near = (F.abs(F.max("_n_trains") - exact) <= COUNT_ERROR * exact + 1).cast("int").alias("n_trains")
    return joined.groupBy(key).agg(F.count(value).alias("n"), *(holds(*x) for x in probabilities.items()), near)
