"""Clock strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTES_PER_DAY = 1440


def is_clock(clock: Column) -> Column:
    """Whether the text opens with whole numbers on both sides of a colon."""
    return clock.rlike(r"^\s*\d{1,6}\s*:\s*\d{1,6}\s*(:|$)")


def clock_part(clock: Column, index: int) -> Column:
    """Hour (0) or minute (1) of ``HH:MM``, null where it is not a whole number.

    The pattern comes first because a cast that fails costs an exception per row.
    """
    part = F.get(F.split(clock, ":"), F.lit(index))
    return F.when(part.rlike(r"^\s*\d{1,6}\s*$"), part.cast("long"))


def to_minutes(clock: Column, day: Column | None = None) -> Column:
    """Minutes since midnight, or since the start of day zero when a day is given."""
    parts = F.split(clock, ":")
    hour, minute = (F.get(parts, F.lit(i)).cast("long") for i in (0, 1))
    start = F.lit(0) if day is None else F.coalesce(day, F.lit(1)) * MINUTES_PER_DAY
    return F.when(is_clock(clock), start + hour * 60 + minute)


def parse_clock(text: Column) -> Column:
    """Minutes since midnight of a hand-typed time, null for words and blanks.

    Accepts ``7.00 AM``, ``21:43``, ``02.:53``, ``14.00``. Zeros a spreadsheet dropped
    after a dot are put back: ``22.1`` is 22:10 and ``5`` is 5:00.
    """
    pattern = r"^\s*(\d{1,2})\s*(?:([.:]+)\s*(\d{1,2}))?\s*(?:([AaPp])\.?[Mm]\.?)?\s*$"

    def part(i: int) -> Column:
        return F.regexp_extract(text, pattern, i)

    hour, minute = part(1).try_cast("int"), part(3).try_cast("int")
    minute = F.when((hour.isNotNull()) & (part(3) == ""), 0).when((part(2) == ".") & (F.length(part(3)) == 1), minute * 10).otherwise(minute)
    half = F.upper(part(4))
    hour = (
        F.when((half == "A") & (hour == 12), 0)
        .when((half == "P") & (hour < 12), hour + 12)
        .otherwise(hour)
    )
    return F.when((hour < 24) & (minute < 60), hour * 60 + minute)


def hour_of_day(clock: Column, default: int = 12) -> Column:
    """Hour of a clock string, with a default where it is missing."""
    return F.coalesce(clock_part(clock, 0).cast("int"), F.lit(default))


def is_peak(hour: Column, spans) -> Column:
    """1 where the hour lies in one of the inclusive spans, else 0."""
    hit = F.lit(False)
    for low, high in spans:
        hit = hit | hour.between(low, high)
    return F.when(hit, 1).otherwise(0)
