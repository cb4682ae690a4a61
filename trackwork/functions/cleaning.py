"""Sentinels, casts, column names and column roles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_if(column: Column, *sentinels: str) -> Column:
    """The column with every sentinel turned into null."""
    return F.when(~column.isin(*sentinels), column)


def number(column: Column) -> Column:
    """A double, or null where the text is not a number."""
    return column.try_cast("double")


def exact_mean(column: Column) -> Column:
    """The mean of a group, the same whatever the order of its rows.

    Sums of doubles depend on the order in which tasks add them, and a mean on a threshold would then
    change with the partitioning. Decimals add up exactly, and the quotient is taken once.
    """
    return F.try_divide(F.sum(column.cast("decimal(28,8)")).cast("double"), F.count(column))


def strip(column: Column) -> Column:
    """Text without white space at either end."""
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def train_number(column: Column) -> Column:
    """The first whole number of four or five digits in a messy train label; longer numbers are none."""
    return F.get(F.regexp_extract_all(column, F.lit(r"(?<!\d)(\d{4,5})(?!\d)"), F.lit(1)), F.lit(0))


def clean_name(name: str | None) -> str:
    words = re.sub(r"[^\w\s]", "", name or "").split()
    return "_".join(words).lower() or "unknown"


def unique_names(names: list[str]) -> list[str]:
    """Number repeated names ``a, a_1, a_2`` without ever hitting an existing one."""
    taken = set(names)
    used: set[str] = set()
    out = []
    for name in names:
        candidate, n = name, 0
        while candidate in used or (n and candidate in taken):
            n += 1
            candidate = f"{name}_{n}"
        used.add(candidate)
        out.append(candidate)
    return out


def sanitize_columns(df: DataFrame) -> DataFrame:
    """Lower-case word names, unique within the frame."""
    return df.toDF(*unique_names([clean_name(c) for c in df.columns]))


def dedupe_columns(df: DataFrame) -> DataFrame:
    """Number repeated column names by position."""
    return df.toDF(*unique_names(df.columns))


def rename_all(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


def existing(df: DataFrame, candidates) -> list[str]:
    """The candidates the frame has, in the given order."""
    return [c for c in candidates if c in df.columns]


def zero_fill(df: DataFrame, names) -> DataFrame:
    """Add each missing column as 0.0."""
    return df.withColumns({n: F.lit(0.0) for n in names if n not in df.columns})


def fill_defaults(df: DataFrame, numeric: dict, categorical=(), unknown: str = "UNKNOWN") -> DataFrame:
    """Replace nulls by per-column defaults, skipping columns the frame lacks."""
    values = {k: v for k, v in numeric.items() if k in df.columns}
    values.update({c: unknown for c in categorical if c in df.columns})
    return df.fillna(values) if values else df


# Sanitised header names per role; an exact name beats a look-alike.
ROLE_NAMES = {
    "train_no": ("train_no", "train_number", "no_201112", "passengers_in_nos"),
    "train_name": ("train_name", "name_of_the_train", "details_of_train"),
    "origin": ("origin", "from", "place_of_dept", "place_from"),
    "destination": ("destination", "to", "place_of_arrl", "place_to"),
    "arrival": ("arrival", "arrival_time", "train_arrival_timings"),
    "departure": ("departure", "departure_time", "depature_time", "timedeparture"),
    "days": ("day", "days", "day_of_service", "days_on_service", "weekdaily"),
    "station_code": ("station_code",),
    "order": ("stop_seq", "seq", "sno", "s_no", "slno"),
    "pm25": ("pm25", "avg_pm25", "pm2_5"),
}

ROLE_PATTERNS = {
    "train_no": r"train.*(no|number)(_|$)",
    "train_name": r"train_name",
    "arrival": r"(arrival|arraival|arrl)(_|$)",
    "departure": r"(departure|depature|dept)(_|$)",
    "station_code": r"station.*code",
    "order": r"(seq|order|idx)",
    "pm25": r"pm_?2_?5",
}


def resolve_role(df: DataFrame, role: str) -> str | None:
    """The column playing a role: an exact known name, else the first look-alike.

    A look-alike that is another role's exact name is passed over.
    """
    for name in ROLE_NAMES.get(role, ()):
        if name in df.columns:
            return name
    taken = {n for other, names in ROLE_NAMES.items() if other != role for n in names}
    pattern = ROLE_PATTERNS.get(role)
    return next(
        (c for c in df.columns if pattern and c not in taken and re.search(pattern, c)), None
    )
