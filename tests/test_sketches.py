"""Stored summaries: merged they tell what the rows tell, within their bounds."""

import numpy as np
from pyspark.sql import functions as F

from trackwork.plans import sketches

POINTS = {"p10": 0.1, "p50": 0.5, "p90": 0.9}


def rows(spark, n):
    i = F.col("id")
    return spark.range(n).select(
        (i % 20).alias("day"), F.when(i % 9 != 0, F.concat(F.lit("z"), i % 3)).alias("zone"), F.concat(F.lit("t"), i % 1700).alias("train_no"),
        F.when(i % 11 != 0, F.pow(F.pmod(F.xxhash64("id"), F.lit(1000)) / 100, 2.0)).alias("arrival_delay_min"),
    )


def test_merged_days_keep_the_bounds(spark):
    df = rows(spark, 40_000)
    daily = sketches.summarise(df, ["day", "zone"])
    assert daily.count() == df.select("day", "zone").distinct().count()
    told = sketches.report(sketches.merged(daily, ["zone"]), ["zone"], POINTS)
    checked = sketches.within_bounds(df, told, "zone", POINTS).collect()
    assert len(checked) == 4 and all(r.p10 == r.p50 == r.p90 == r.n_trains == 1 for r in checked)
    assert sum(r.n for r in checked) == df.where("arrival_delay_min is not null").count()


def test_few_rows_are_exact(spark):
    df = rows(spark, 100)
    row = sketches.report(sketches.merged(sketches.summarise(df, ["day"]), []), [], {"p50": 0.5}).first()
    values = sorted(r[0] for r in df.select("arrival_delay_min").where("arrival_delay_min is not null").collect())
    assert row.n == len(values) and abs(np.searchsorted(values, row.p50, "left") - len(values) / 2) <= 2
    assert row.n_trains == 100


def test_wrong_reports_are_seen(spark):
    df = rows(spark, 3000)
    told = sketches.report(sketches.summarise(df, ["zone"]), ["zone"], POINTS)
    off = told.withColumns({"p50": F.col("p90"), "n_trains": F.col("n_trains") * 2})
    assert {(r.p10, r.p50, r.n_trains) for r in sketches.within_bounds(df, off, "zone", POINTS).collect()} == {(1, 0, 0)}


def test_groups_without_values(spark):
    df = rows(spark, 50).withColumn("arrival_delay_min", F.lit(None).cast("double")).withColumn("train_no", F.lit(None).cast("string"))
    told = sketches.report(sketches.merged(sketches.summarise(df, ["day", "zone"]), ["zone"]), ["zone"], POINTS).collect()
    assert all((r.n, r.p50, r.n_trains) == (0, None, 0) for r in told)
    assert sketches.summarise(df.where("false"), ["day"]).count() == 0
