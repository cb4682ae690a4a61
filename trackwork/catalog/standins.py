"""Rail tables as views over the star-schema test tables.

The rail feeds are not part of this repository. Every table below is a row-by-row
projection of one test table (stations also look up nation and region), so it grows
with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trackwork import fixed_values as fv

ZONES = [zone for zone, _ in fv.ZONE_STATES]
STATES = [state for _, state in fv.ZONE_STATES]
TRAIN_TYPES = {
    "1-URGENT": "Rajdhani",
    "2-HIGH": "Exp",
    "3-MEDIUM": "SF",
    "4-NOT SPECIFIED": "Pass",
    "5-LOW": "MEMU",
}
EVENT_POLLUTANTS = {
    "click": "PM2.5",
    "view": "PM10",
    "purchase": "NO2",
    "signup": "SO2",
    "error": "OZONE",
}


SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; its schema is read from the file once per session."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in SCHEMAS:
        SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(SCHEMAS[path]).parquet(path)


def text(column: Column) -> Column:
    return column.cast("string")


def pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), index.cast("int"))


def lookup(values: dict[str, str], column: Column) -> Column:
    out = None
    for key, value in values.items():
        out = F.when(column == key, value) if out is None else out.when(column == key, value)
    return out


def two_digits(number: Column) -> Column:
    return F.lpad(text(number.cast("int")), 2, "0")


def station_code(key: Column) -> Column:
    """The first keys carry the junction codes, the rest their number."""
    return F.when(key < len(fv.JUNCTIONS), pick(list(fv.JUNCTIONS), key)).otherwise(text(key))


def station_name(key: Column) -> Column:
    return F.concat(F.lit("Nation_"), text(key % 25))


def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stop per line item. Origins arrive 'None'; some departures are 'None' or garbled."""
    key, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    hour, minute = key % 24, supp % 60
    arrived = (hour * 60 + minute - key % 13 + 1440) % 1440
    return table(spark, sf_dir, "lineitem").select(
        text(F.col("l_orderkey")).alias("train_number"),
        F.concat(F.lit("Train "), text(F.col("l_orderkey"))).alias("train_name"),
        station_code(supp).alias("station_code"),
        station_name(supp).alias("station_name"),
        F.nullif(line, F.lit(7)).alias("day"),
        F.when(line == 1, "None")
        .otherwise(F.concat(two_digits(F.floor(arrived / 60)), F.lit(":"), two_digits(arrived % 60)))
        .alias("arrival"),
        F.when((line == 6) & (key % 2 == 0), "None")
        .when(key % 97 == 0, "--:--")
        .otherwise(F.concat(two_digits(hour), F.lit(":"), two_digits(minute)))
        .alias("departure"),
        F.to_date("l_shipdate").alias("run_date"),
    )


def trains(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        text(key).alias("train_no"),
        F.concat(F.lit("Train "), text(key)).alias("train_name"),
        lookup(TRAIN_TYPES, F.col("o_orderpriority")).alias("train_type"),
        pick(ZONES, F.col("o_custkey") % 17).alias("zone"),
        F.floor(price / 200).cast("int").alias("total_distance_km"),
        F.floor(price / 20000).cast("int").alias("duration_hours"),
        (key % 2).cast("int").alias("has_sleeper"),
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    nations = table(spark, sf_dir, "nation")
    regions = table(spark, sf_dir, "region")
    return (
        table(spark, sf_dir, "supplier")
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            station_code(key).alias("station_code"),
            station_name(key).alias("station_name"),
            F.col("n_name").alias("state"),
            F.when(key % 10 != 0, pick(ZONES, key % 17)).alias("zone"),
            F.col("r_name").alias("address"),
            (key % 29 + 68).cast("double").alias("longitude"),
            (key % 28 + 8).cast("double").alias("latitude"),
        )
    )


def air_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reading per event; one in ten is 'NA', and ids and cities are padded."""
    place = F.col("user_id") % 25
    reading = F.col("value") * (place + 1)
    return table(spark, sf_dir, "events").select(
        F.lit("India").alias("country"),
        pick(STATES, F.col("user_id") % 17).alias("state"),
        F.concat(F.lit(" Nation_"), text(place), F.lit(" ")).alias("city"),
        F.concat(F.lit("ST"), text(F.col("user_id"))).alias("station"),
        F.date_format("ts", "dd-MM-yyyy HH:mm:ss").alias("last_update"),
        (place + 8).cast("double").alias("latitude"),
        (place + 68).cast("double").alias("longitude"),
        F.concat(F.lit(" "), lookup(EVENT_POLLUTANTS, F.col("event_type")), F.lit(" ")).alias("pollutant_id"),
        reading.alias("pollutant_min"),
        reading.alias("pollutant_max"),
        F.when(F.col("event_id") % 10 == 0, "NA").otherwise(text(reading)).alias("pollutant_avg"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rulebook page per document; some open with a section number or a passenger's word."""
    doc = F.col("doc_id")
    section = F.concat(text(doc % 90 + 54), F.when(doc % 2 == 0, "A. ").otherwise(". "))
    return table(spark, sf_dir, "documents").select(
        "source",
        F.concat(F.lit("Rulebook "), F.col("source")).alias("source_title"),
        doc.alias("page"),
        F.concat(
            F.when(doc % 3 == 0, section).otherwise(""),
            F.when(doc % 5 == 0, "Ticket refund. ").otherwise(""),
            F.col("text"),
        ).alias("text"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delay request per customer; many name a train or station without history."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("request_id"),
        text(key * 3).alias("train_no"),
        station_code(key % 997).alias("station_code"),
        (key % 24).cast("int").alias("scheduled_hour"),
        F.when(key % 3 != 0, F.col("c_nationkey") * F.lit(8.0)).alias("pm25"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text")
    )


def label_centroids(spark: SparkSession, sf_dir: str, dim: int = 64) -> DataFrame:
    """A query vector per label: the mean of its embeddings."""
    means = [F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(dim)]
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("query_id")).agg(
        F.array(*means).alias("vector")
    )


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")
    )
