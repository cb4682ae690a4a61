"""Checks on the label distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackwork import fixed_values as fv
from trackwork.operators.skew import exact_percentiles

PERCENTILES = {"p50": 0.5, "p90": 0.9}


def delay_distribution(labelled: DataFrame, column: str = "arrival_delay_min", approx: bool = False) -> DataFrame:
    """Median, 90th percentile, and the shares of punctual and badly delayed stops."""
    if approx:
        points = [F.round(F.percentile_approx(column, p), 1).alias(n) for n, p in PERCENTILES.items()]
        return labelled.agg(*points, *_shares(F.col(column), F.lit(1)))
    points = exact_percentiles(labelled, column, PERCENTILES, 0.0, fv.MAX_DELAY_MIN)
    rows = points.withColumns({n: F.round(n, 1) for n in PERCENTILES}).unionByName(
        labelled.where(F.col(column).isNotNull()).agg(*_shares(F.col(column), F.lit(1))), allowMissingColumns=True
    )
    return rows.agg(*(F.max(c).alias(c) for c in rows.columns))


def _shares(delay: Column, weight: Column) -> list[Column]:
    def share(condition: Column, name: str) -> Column:
        hits = F.sum(F.when(condition, weight).otherwise(0))
        return F.round(F.try_divide(F.lit(100.0) * hits, F.sum(weight)), 1).alias(name)

    return [share(delay < 5, "pct_on_time"), share(delay > fv.MAJOR_DELAY_MIN, "pct_major_delay")]
