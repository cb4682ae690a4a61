"""What a passenger sees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwork import fixed_values as fv
from trackwork.functions.factors import floor_delay, fog_label, risk_label


def passenger_forecast(scored: DataFrame) -> DataFrame:
    """Delay shown, risk and fog labels, and the question about rights it leads to."""
    shown = scored.withColumn("delay_shown", floor_delay(F.col("predicted_delay_min")))
    return shown.withColumns(
        {
            "risk": risk_label(F.col("delay_shown")),
            "fog": fog_label(F.col("pm25")),
            "rights_question": F.format_string(fv.RIGHTS_QUESTION, F.floor("delay_shown").cast("long")),
        }
    )


def rights_queries(scored: DataFrame) -> DataFrame:
    """Distinct retrieval queries for the delays that occur."""
    return passenger_forecast(scored).groupBy(F.col("rights_question").alias("query_text")).agg(
        F.count(F.lit(1)).alias("stops")
    )
