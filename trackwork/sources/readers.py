"""Files with a known shape, read with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwork import fixed_values as fv

AIR_SCHEMA = (
    "country string, state string, city string, station string, last_update string, "
    "latitude double, longitude double, pollutant_id string, pollutant_min double, "
    "pollutant_max double, pollutant_avg string"
)
SCHEDULE_SCHEMA = (
    "train_number string, train_name string, station_code string, station_name string, "
    "day int, arrival string, departure string"
)
# Property of a train feature -> column.
TRAIN_PROPERTIES = {
    "number": "train_no",
    "name": "train_name",
    "type": "train_type",
    "zone": "zone",
    "from_station_code": "from_code",
    "to_station_code": "to_code",
    "from_station_name": "from_name",
    "to_station_name": "to_name",
    "departure": "origin_departure",
    "arrival": "terminus_arrival",
    "distance": "total_distance_km",
    "duration_h": "duration_hours",
    "duration_m": "duration_minutes_extra",
    "sleeper": "has_sleeper",
    "third_ac": "has_3ac",
    "second_ac": "has_2ac",
    "first_ac": "has_1ac",
    "chair_car": "has_chair",
}
WHOLE_NUMBER_PROPERTIES = {"distance", "duration_h", "duration_m", "sleeper", "third_ac", "second_ac", "first_ac", "chair_car"}
TRAIN_FEATURES_SCHEMA = (
    "type string, features array<struct<type: string, properties: struct<"
    + ", ".join(f"{p}: {'int' if p in WHOLE_NUMBER_PROPERTIES else 'string'}" for p in TRAIN_PROPERTIES)
    + ">>>"
)
STATION_FEATURES_SCHEMA = (
    "type string, features array<struct<type: string, properties: struct<code: string, "
    "name: string, state: string, zone: string, address: string>, "
    "geometry: struct<type: string, coordinates: array<double>>>>"
)


def read_csv(spark: SparkSession, path, schema: str) -> DataFrame:
    """CSV with a header row; fields that do not fit their type read as null."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


def read_aq(spark: SparkSession, path) -> DataFrame:
    return read_csv(spark, path, AIR_SCHEMA)


def read_json(spark: SparkSession, path, schema: str, lines: bool = True) -> DataFrame:
    """JSON records: one per line (splittable), or one array or object per file."""
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_schedules(spark: SparkSession, path, lines: bool = True) -> DataFrame:
    return read_json(spark, path, SCHEDULE_SCHEMA, lines)


def flatten_trains(collections: DataFrame) -> DataFrame:
    """One row per train feature."""
    feature = collections.select(F.explode("features").alias("f"))
    return feature.select(
        *(F.col(f"f.properties.{p}").alias(c) for p, c in TRAIN_PROPERTIES.items())
    )


def flatten_stations(collections: DataFrame) -> DataFrame:
    """One row per station feature that has a code."""
    feature = collections.select(F.explode("features").alias("f"))
    place = F.col("f.geometry.coordinates")
    return feature.select(
        F.col("f.properties.code").alias("station_code"),
        F.col("f.properties.name").alias("station_name"),
        F.col("f.properties.state").alias("state"),
        F.col("f.properties.zone").alias("zone"),
        F.col("f.properties.address").alias("address"),
        F.get(place, F.lit(0)).alias("longitude"),
        F.get(place, F.lit(1)).alias("latitude"),
    ).where(F.col("station_code").isNotNull())


def read_trains(spark: SparkSession, path, lines: bool = False) -> DataFrame:
    return flatten_trains(read_json(spark, path, TRAIN_FEATURES_SCHEMA, lines))


def read_stations(spark: SparkSession, path, lines: bool = False) -> DataFrame:
    return flatten_stations(read_json(spark, path, STATION_FEATURES_SCHEMA, lines))


def with_lineage(df: DataFrame) -> DataFrame:
    """File and time of ingest; call it on a frame fresh from a file reader."""
    return df.withColumns(
        {"_source_file": F.col("_metadata.file_path"), "_ingest_ts": F.current_timestamp()}
    )


def load_history(df: DataFrame, candidates=fv.DATE_COLUMNS) -> DataFrame:
    """Running history with run_date, year and month; unchanged without a date column."""
    by_lower = {c.lower(): c for c in reversed(df.columns)}
    date = next((by_lower[c] for c in candidates if c in by_lower), None)
    if date is None:
        return df
    run_date = F.to_date(F.col(date).try_cast("timestamp"))
    return df.withColumn("run_date", run_date).withColumns(
        {"year": F.year("run_date"), "month": F.month("run_date")}
    )
