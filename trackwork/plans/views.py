"""Reporting views. Each takes the table it reports on and stays lazy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwork import fixed_values as fv
from trackwork.functions.cleaning import number
from trackwork.functions.factors import is_junction, rule_delay
from trackwork.operators.features import capped


def rounded_mean(column: str, digits: int = 1):
    return F.round(F.avg(number(F.col(column))), digits)


def feature_ranges(features: DataFrame) -> DataFrame:
    """Counts and ranges in one row. Each distinct count is a plan of its own, so that rows are not copied."""
    ranges = features.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.round(F.avg("stop_seq"), 1).alias("avg_stop_seq"),
        F.max("total_stops").alias("max_stops"),
        F.round(F.avg("cumulative_travel_min"), 1).alias("avg_cumulative_min"),
        F.round(F.avg("dwell_min"), 2).alias("avg_dwell_min"),
        F.round(F.avg("pm25"), 1).alias("avg_pm25"),
    )
    distinct = {"unique_trains": "train_no", "unique_stations": "station_code"}
    for name, column in distinct.items():
        counted = features.select(column).distinct().agg(F.count(column).alias(name))
        ranges = ranges.unionByName(counted, allowMissingColumns=True)
    order = ["total_records", *distinct, "avg_stop_seq", "max_stops", "avg_cumulative_min", "avg_dwell_min", "avg_pm25"]
    return ranges.agg(*(F.max(c).alias(c) for c in order))


def zone_pm25(features: DataFrame) -> DataFrame:
    return (
        features.where(F.col("zone").isNotNull())
        .groupBy("zone")
        .agg(
            F.round(F.avg("pm25"), 1).alias("avg_pm25"),
            F.countDistinct("train_no").alias("trains"),
            F.count(F.lit(1)).alias("stop_records"),
        )
        .orderBy(F.desc("avg_pm25"), "zone")
    )


def delay_by_zone(labelled: DataFrame) -> DataFrame:
    return (
        labelled.where(F.col("zone").isNotNull())
        .groupBy("zone")
        .agg(
            F.round(F.avg("pm25"), 1).alias("avg_pm25"),
            F.round(F.avg("arrival_delay_min"), 1).alias("avg_delay"),
            F.countDistinct("train_no").alias("trains"),
        )
        .orderBy(F.desc("avg_delay"), "zone")
    )


def polluted_cities(air_wide: DataFrame, k: int = 15) -> DataFrame:
    return (
        air_wide.where(F.col("pm25").isNotNull())
        .groupBy("city")
        .agg(
            F.round(F.avg("pm25"), 1).alias("avg_pm25"),
            F.round(F.avg("no2"), 1).alias("avg_no2"),
            F.count(F.lit(1)).alias("observation_days"),
        )
        .orderBy(F.desc("avg_pm25"), "city")
        .limit(k)
    )


def with_city(features: DataFrame) -> DataFrame:
    """The city of a stop is its station's name."""
    return features.withColumn("city", F.upper("station_name"))


def trains_by_city(features: DataFrame) -> DataFrame:
    return (
        features.where(F.col("city").isNotNull())
        .groupBy("city")
        .agg(
            F.count(F.lit(1)).alias("scheduled_trains"),
            rounded_mean("pm25").alias("avg_pm25"),
            rounded_mean("no2").alias("avg_no2"),
        )
    )


def hourly_schedule(features: DataFrame) -> DataFrame:
    return (
        features.where(F.col("scheduled_hour").isNotNull())
        .groupBy("scheduled_hour")
        .agg(F.count(F.lit(1)).alias("num_trains"))
        .orderBy("scheduled_hour")
    )


def rules_by_source(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source", "source_title").agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.min("page").alias("first_page"),
        F.max("page").alias("last_page"),
    )


def chunks_by_source(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source").agg(F.count(F.lit(1)).alias("chunk_count"))


def polluted_routes(features: DataFrame) -> DataFrame:
    return (
        features.where(F.col("pm25").isNotNull() & F.col("city").isNotNull())
        .groupBy("city")
        .agg(
            rounded_mean("pm25").alias("avg_pm25"),
            F.countDistinct("train_no").alias("trains_affected"),
        )
        .orderBy(F.desc("avg_pm25"), "city")
    )


def top_polluted_routes(features: DataFrame, k: int = 15) -> DataFrame:
    """The k most polluted cities with their train counts."""
    return polluted_routes(features).limit(k)


def hazardous_cities(features: DataFrame, limit: float = fv.HEAVY_PM25) -> DataFrame:
    """How many cities average more than ``limit``."""
    heavy = polluted_routes(features).where(F.col("avg_pm25") > limit)
    return heavy.agg(F.count(F.lit(1)).alias("hazardous_cities"))


def total_trains(features: DataFrame, approx: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approx else F.countDistinct
    return features.agg(count("train_no").alias("total_trains"))


def avg_predicted_delay(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.round(F.avg("predicted_delay_min"), 1).alias("avg_predicted_delay"))


def monthly_delay(predictions: DataFrame) -> DataFrame:
    return (
        predictions.groupBy(F.month("run_date").alias("m"))
        .agg(F.round(F.avg("predicted_delay_min"), 1).alias("avg_delay"))
        .orderBy("m")
    )


def delayed_pairs(predictions: DataFrame, k: int = 10) -> DataFrame:
    """Train-station pairs with the longest mean predicted delay."""
    return (
        predictions.groupBy("train_no", "station_code")
        .agg(F.round(F.avg("predicted_delay_min"), 1).alias("avg_delay"))
        .orderBy(F.desc("avg_delay"), "train_no", "station_code")
        .limit(k)
    )


def scatter(predictions: DataFrame, key_cols, n: int = fv.SCATTER_ROWS) -> DataFrame:
    """Up to n (pm25, predicted delay) points, the same ones on every run."""
    known = predictions.where(F.col("pm25").isNotNull())
    points = known.select(*key_cols, "pm25", "predicted_delay_min")
    return capped(points, n, key_cols)


def highest_prediction(predictions: DataFrame) -> DataFrame:
    """The row with the largest prediction."""
    return top_k(predictions, "predicted_delay_min", 1, ("train_no", "station_code"))


def top_k(df: DataFrame, by: str, k: int, ties=()) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(k)


def preview(df: DataFrame, n: int, keys) -> DataFrame:
    """The first n rows by key."""
    return df.orderBy(*keys).limit(n)


def busiest_junction(features: DataFrame, codes=fv.JUNCTIONS, k: int = 1) -> DataFrame:
    """The junction station with the most trains."""
    return (
        features.where(is_junction(F.col("station_code"), codes) == 1)
        .groupBy("station_code")
        .agg(F.countDistinct("train_no").alias("trains"))
        .orderBy(F.desc("trains"), "station_code")
        .limit(k)
    )


def trains_through(features: DataFrame, city: str) -> DataFrame:
    """How many trains stop in a city."""
    stops = features.where(F.col("city") == city.upper())
    return stops.agg(F.countDistinct("train_no").alias("trains"))


def polluted_trains(features: DataFrame, limit: float = fv.HEAVY_PM25) -> DataFrame:
    """Trains that stop where the air is heavy."""
    return features.where(F.col("pm25") > limit).select("train_no", "train_name").distinct()


def rule_predictions(features: DataFrame, run_date=None) -> DataFrame:
    """Rule-based predicted delay and run date on every stop."""
    day = F.lit(fv.RULE_RUN_DATE).cast("date") if run_date is None else run_date
    return features.withColumns(
        {"predicted_delay_min": rule_delay(F.col("pm25"), F.col("is_peak_hour")), "run_date": day}
    )
