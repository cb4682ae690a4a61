"""Air-quality readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwork import fixed_values as fv
from trackwork.functions.cleaning import exact_mean, null_if, number


def clean_air(air_long: DataFrame) -> DataFrame:
    """Normalised city, observation date and numeric reading next to the raw columns."""
    return air_long.select(
        F.upper(F.trim("city")).alias("city"),
        "state",
        F.to_date(F.try_to_timestamp("last_update", F.lit("dd-MM-yyyy HH:mm:ss"))).alias("obs_date"),
        "latitude",
        "longitude",
        F.trim("pollutant_id").alias("pollutant_id"),
        number(null_if(F.col("pollutant_avg"), "NA")).alias("reading"),
    )


def pivot_air(air_long: DataFrame) -> DataFrame:
    """One row per city, date and place with a mean reading per pollutant."""
    return (
        clean_air(air_long)
        .groupBy("city", "obs_date", "latitude", "longitude")
        .pivot("pollutant_id", list(fv.POLLUTANTS))
        .agg(exact_mean(F.col("reading")))
        .withColumnsRenamed(fv.POLLUTANTS)
    )


def city_air(air_wide: DataFrame) -> DataFrame:
    """Mean readings per city, so that a join on city keeps the row count."""
    return air_wide.groupBy(F.upper("city").alias("city")).agg(
        *(exact_mean(F.col(c)).alias(c) for c in fv.AIR_DEFAULTS)
    )


def zone_state_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fv.ZONE_STATES), "zone string, state_for_aq string")


def zone_air(zones: DataFrame, air_long: DataFrame) -> DataFrame:
    """Mean PM2.5 of the state each zone stands for."""
    state_pm25 = (
        clean_air(air_long)
        .where(F.col("pollutant_id") == "PM2.5")
        .groupBy(F.upper(F.trim("state")).alias("state_for_aq"))
        .agg(exact_mean(F.col("reading")).alias("state_pm25"))
    )
    return zones.join(state_pm25, "state_for_aq", "left").select("zone", "state_for_aq", "state_pm25")
