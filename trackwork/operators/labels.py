"""Delay labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwork import fixed_values as fv
from trackwork.functions import factors
from trackwork.functions.noise import row_key, standard_normal

ROW_KEY = ("train_no", "stop_seq")


def label_delays(df: DataFrame, key_cols=ROW_KEY, seed: int = 42) -> DataFrame:
    """Five factor columns and ``arrival_delay_min``: log-normal noise times the factors.

    The noise is drawn from the row key, so a row keeps its label under any partitioning.
    """
    stops = F.col("total_stops")
    ratio = F.when(stops > 0, F.col("stop_seq") / F.nullif(stops, F.lit(0))).otherwise(0.0)
    noise = F.exp(standard_normal(row_key(key_cols, seed)) * fv.NOISE_SIGMA + fv.NOISE_MU)
    out = df.withColumns(
        {
            "fog_factor": factors.fog_factor(F.col("pm25")),
            "type_factor": factors.type_factor(F.col("train_type")),
            "stop_factor": F.lit(1.0) + ratio * fv.STOP_SLOPE,
            "peak_factor": F.when(F.col("is_peak_hour") == 1, fv.PEAK_FACTOR).otherwise(1.0),
            "dwell_factor": factors.dwell_factor(F.col("dwell_min"), F.col("stop_seq")),
        }
    )
    delay = (
        noise
        * F.col("fog_factor")
        * F.col("type_factor")
        * F.col("stop_factor")
        * F.col("peak_factor")
        * F.col("dwell_factor")
    )
    return out.withColumn("arrival_delay_min", factors.clip_delay(delay))
