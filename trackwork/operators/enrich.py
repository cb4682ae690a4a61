"""Joins of timetable features with trains, stations and air quality.

Stations are counted, and sent to the tasks while there are few enough, so that the stops are not dealt once
more by station. The means of cities are written, so that Spark sees how few they are; it would judge them by the
size of all readings, and deal the stops by city. No other side carries a hint: Spark broadcasts a dimension
when its measured size is under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise sorts and merges, where
adaptive execution splits a skewed key of the large left side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwork import fixed_values as fv
from trackwork.functions.cleaning import resolve_role, unique_names
from trackwork.functions.clock import hour_of_day, is_peak
from trackwork.functions.factors import coarse_fog_factor
from trackwork.operators.air import city_air
from trackwork.operators.schedule import sequence_by
from trackwork.session import scratch_path
from trackwork.sinks.tables import write_table

#: Stations up to which a copy goes to every task, about 100 bytes each; more are joined by code.
SENT_STATIONS = 500_000


def join_dimension(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Left join on one column; dimension names already taken are numbered first."""
    names = unique_names([*df.columns, *(c for c in dimension.columns if c != key)])
    fresh = iter(names[len(df.columns):])
    renamed = dimension.select(
        key, *(F.col(c).alias(next(fresh)) for c in dimension.columns if c != key)
    )
    return df.join(renamed, key, "left")


def enrich(
    features: DataFrame,
    trains: DataFrame,
    stations: DataFrame,
    air_wide: DataFrame,
    fanout: bool = False,
) -> DataFrame:
    """Train, station and air columns on every stop.

    Readings are averaged per city first, in a job of their own; ``fanout`` joins the dated rows instead, one
    output row per matching reading row.
    """
    trains = trains.select(
        F.col("train_no").cast("string").alias("train_no"),
        "train_type",
        F.col("zone").alias("train_zone"),
        "total_distance_km",
        "duration_hours",
        "has_sleeper",
    )
    stations = stations.select(
        "station_code", "state", F.col("zone").alias("station_zone"), "latitude", "longitude"
    )
    if stations.limit(SENT_STATIONS + 1).count() <= SENT_STATIONS:
        stations = F.broadcast(stations)
    if fanout:
        air = air_wide.select(F.upper("city").alias("_city"), *fv.AIR_DEFAULTS)
    else:
        means = city_air(air_wide).withColumnRenamed("city", "_city")
        air = write_table(means, scratch_path(means.sparkSession, "city-air"))
    joined = (
        features.join(trains, "train_no", "left")
        .join(stations, "station_code", "left")
        .withColumn("_city", F.upper("station_name"))
        .join(air, "_city", "left")
    )
    return joined.select(
        *features.columns,
        "train_type",
        "train_zone",
        "total_distance_km",
        "duration_hours",
        "has_sleeper",
        "state",
        F.coalesce("station_zone", "train_zone").alias("zone"),
        "latitude",
        "longitude",
        *(F.coalesce(c, F.lit(v)).alias(c) for c, v in fv.AIR_DEFAULTS.items()),
    )


def enrich_timings(
    timings: DataFrame,
    trains: DataFrame,
    stations: DataFrame,
    air: DataFrame,
    **number_options,
) -> DataFrame:
    """Second silver table: whatever columns the timing sheets have, joined where they can be.

    Needs a train number; order, departure time, station code, state and city are used
    when present. Copies of a dimension row are dropped before its join; the sheets' own
    copies stay, told apart by their position.
    """
    timings = timings.dropna(how="all")
    train_no = resolve_role(timings, "train_no")
    if train_no is None:
        raise ValueError("no train number column")
    timings = timings.withColumnRenamed(train_no, "train_no")
    timings = timings.withColumn("train_no", F.col("train_no").cast("string"))
    order = resolve_role(timings, "order") or timings.columns[0]
    departure = resolve_role(timings, "departure")
    out = sequence_by(timings, "train_no", order, **number_options)
    clock = F.col(departure) if departure else F.lit(None).cast("string")
    out = out.withColumn("hour_of_day", hour_of_day(clock))
    out = out.withColumn("is_peak_hour", is_peak(F.col("hour_of_day"), fv.PEAK_TIMINGS))

    out = join_dimension(out, trains.dropDuplicates(), "train_no")
    station = resolve_role(out, "station_code")
    if station and station in stations.columns:
        out = join_dimension(out, stations.dropDuplicates(), station)
    key = next((k for k in ("state", "city") if k in out.columns and k in air.columns), None)
    if key:
        out = join_dimension(out, air.dropDuplicates(), key)
    pm25 = resolve_role(out, "pm25")
    if pm25:
        out = out.withColumn(pm25, F.col(pm25).try_cast("double"))
    return out.withColumn("fog_factor", coarse_fog_factor(F.col(pm25) if pm25 else None))


def with_processed_ts(df: DataFrame) -> DataFrame:
    return df.withColumn("_processed_ts", F.current_timestamp())
