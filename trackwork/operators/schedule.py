"""Timetable features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwork import fixed_values as fv
from trackwork.functions.cleaning import null_if
from trackwork.functions.clock import MINUTES_PER_DAY, clock_part, is_clock, is_peak, to_minutes
from trackwork.functions.factors import route_category
from trackwork.operators.skew import HOT_ROWS, number_rows


def clean_schedules(schedules: DataFrame) -> DataFrame:
    """Arrival ``'None'`` becomes null."""
    return schedules.withColumn("arrival", null_if(F.col("arrival"), "None"))


def schedule_features(
    schedules: DataFrame,
    overnight: bool = False,
    peak=fv.PEAK_TIMETABLE,
    keep: tuple[str, ...] = (),
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Stop order, journey time, dwell, peak flag and route length per train stop.

    Stops without a readable departure are left out, so a terminus does not count
    towards ``total_stops``. Arrival and departure share one day number; a dwell over
    midnight reads as 0 unless ``overnight`` adds the missing day.
    """
    train_no = F.col("train_number").cast("string").alias("train_no")
    parsed = schedules.where(is_clock(F.col("departure"))).select(
        train_no,
        "train_name",
        "station_code",
        "station_name",
        F.col("day").alias("journey_day"),
        "arrival",
        "departure",
        to_minutes(F.col("departure"), F.col("day")).alias("dep_abs_min"),
        *keep,
    )

    ties = ["station_code", "journey_day", "arrival", "departure", "train_name", "station_name", *keep]
    placed = number_rows(
        parsed,
        "train_no",
        ["dep_abs_min", *ties],
        levels=["dep_abs_min", "station_code"],
        position="stop_seq",
        size="total_stops",
        first="origin_dep_min",
        hot_rows=hot_rows,
        census=schedules.select(train_no),
    )

    departed = F.col("dep_abs_min")
    arrived = to_minutes(F.col("arrival"), F.col("journey_day"))
    if overnight:
        arrived = F.when(arrived > departed, arrived - MINUTES_PER_DAY).otherwise(arrived)
    hour = clock_part(F.col("departure"), 0).cast("int")
    return placed.select(
        "train_no",
        "train_name",
        "station_code",
        "station_name",
        "journey_day",
        "arrival",
        "departure",
        hour.alias("scheduled_hour"),
        "stop_seq",
        "total_stops",
        (departed - F.col("origin_dep_min")).alias("cumulative_travel_min"),
        F.coalesce(F.greatest(departed - arrived, F.lit(0)), F.lit(0)).alias("dwell_min"),
        is_peak(hour, peak).alias("is_peak_hour"),
        route_category(F.col("total_stops")).alias("route_length_cat"),
        *keep,
    )


def sequence_by(
    df: DataFrame, key: str, order: str, name: str = "stop_seq", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """1-based position within the key by an order column.

    Numbers go by value; what is no number comes before them, by its text, nulls first.
    """
    lowest = F.lit(float("-inf"))
    lead = F.coalesce(F.nanvl(F.col(order).try_cast("double"), lowest), lowest)
    block = F.floor(F.greatest(lead, F.lit(-1e12)) / 4096)
    rest = [c for c in df.columns if c not in (key, order)]
    numbered = number_rows(
        df.withColumns({"_lead": lead, "_block": block}),
        key,
        ["_lead", order, *rest],
        levels=["_block", "_lead", order],
        position=name,
        hot_rows=hot_rows,
    )
    return numbered.withColumn(name, F.col(name) + 1).drop("_lead")
