"""First-match ladders over delays, air readings and train types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackwork import fixed_values as fv


def ladder(steps, otherwise) -> Column:
    """``steps`` is a sequence of (condition, value); the first true one wins."""
    out = None
    for condition, value in steps:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise)


def fog_factor(pm25: Column) -> Column:
    return ladder(((pm25 >= limit, f) for limit, f in fv.FOG_LADDER), 1.0)


def coarse_fog_factor(pm25: Column | None) -> Column:
    if pm25 is None:
        return F.lit(1.0)
    return ladder(((pm25 > limit, f) for limit, f in fv.COARSE_FOG_LADDER), 1.0)


def type_factor(train_type: Column) -> Column:
    return ladder(((train_type.rlike(p), f) for p, f in fv.TRAIN_TYPE_LADDER), 1.0)


def dwell_factor(dwell: Column, stop_seq: Column) -> Column:
    return ladder((((dwell > limit) & (stop_seq > 0), f) for limit, f in fv.DWELL_LADDER), 1.0)


def route_category(stops: Column) -> Column:
    return ladder(((stops > 100, "long"), (stops > 30, "medium")), "short")


def rule_delay(pm25: Column, peak: Column) -> Column:
    steps = [(pm25 > limit, minutes) for limit, minutes in fv.RULE_PM25]
    return ladder([*steps, (peak == 1, fv.RULE_PEAK)], fv.RULE_OTHER)


def risk_label(delay: Column) -> Column:
    return ladder(((delay > limit, label) for limit, label in fv.RISK_LADDER), "Low")


def fog_label(pm25: Column) -> Column:
    return ladder(((pm25 > limit, label) for limit, label in fv.FOG_LABEL_LADDER), "Low")


def clip_delay(delay: Column) -> Column:
    """A delay in minutes held within [0, 360]."""
    return F.least(F.greatest(delay, F.lit(0.0)), F.lit(fv.MAX_DELAY_MIN))


def floor_delay(delay: Column) -> Column:
    """A delay shown to a passenger: not negative, one decimal."""
    return F.round(F.greatest(delay, F.lit(0.0)), 1)


def is_junction(code: Column, codes=fv.JUNCTIONS) -> Column:
    return F.coalesce(code.isin(*codes), F.lit(False)).cast("int")
