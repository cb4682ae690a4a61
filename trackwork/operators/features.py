"""Encoding, splitting and sampling for the delay model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackwork import fixed_values as fv
from trackwork.functions.cleaning import existing, fill_defaults
from trackwork.functions.clock import is_peak
from trackwork.functions.factors import is_junction
from trackwork.functions.noise import hash_int, row_key
from trackwork.operators.skew import aside, same, smallest_by_hash
from trackwork.session import scratch_path
from trackwork.sinks.tables import write_table


def value_counts(df: DataFrame, cols=fv.FREQUENCY_FEATURES) -> dict[str, DataFrame]:
    """Per column its values with ``{c}_freq``, how often each occurs.

    Written, so that several frames can be encoded by one count, and that Spark sees how few the values are.
    """
    spark = df.sparkSession
    counted = {c: df.groupBy(c).agg(F.count(F.lit(1)).cast("double").alias(f"{c}_freq")) for c in existing(df, cols)}
    return {c: write_table(counts, scratch_path(spark, f"{c}-counts")) for c, counts in counted.items()}


def frequency_encode(df: DataFrame, cols=fv.FREQUENCY_FEATURES, counts_from: DataFrame | dict[str, DataFrame] | None = None) -> DataFrame:
    """``{c}_freq``: how often the row's value occurs, 1 where it is unknown.

    Counts come from ``counts_from`` when given (a training set, say, or its ``value_counts``), else from ``df``.
    """
    source = df if counts_from is None else counts_from
    names = existing(df, cols)
    found = source if isinstance(source, dict) else value_counts(source, names)
    for c in names:
        df = df.join(found[c], c, "left").withColumn(f"{c}_freq", F.coalesce(f"{c}_freq", F.lit(1.0)))
    return df


def index_categories(df: DataFrame, cols=fv.CATEGORY_FEATURES) -> DataFrame:
    """``{c}_code``: place of the value in the sorted list of distinct values, -1 for null.

    For columns with few distinct values; only those are ordered.
    """
    for c in existing(df, cols):
        distinct = df.select(c).where(F.col(c).isNotNull()).distinct()
        codes = distinct.withColumn(f"{c}_code", F.row_number().over(Window.orderBy(c)) - 1)
        df = df.join(codes, c, "left").withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(-1)))
    return df


def fill_features(df: DataFrame) -> DataFrame:
    """Model inputs without nulls."""
    return fill_defaults(df, fv.NUMERIC_DEFAULTS, fv.CATEGORY_FEATURES, fv.UNKNOWN)


def complete_features(df: DataFrame) -> DataFrame:
    """Every model input present and filled, the absent ones with their defaults."""
    absent = [c for c in fv.NUMERIC_DEFAULTS if c not in df.columns]
    df = df.withColumns({c: F.lit(fv.NUMERIC_DEFAULTS[c]) for c in absent})
    df = df.withColumns({c: F.lit(fv.UNKNOWN) for c in fv.CATEGORY_FEATURES if c not in df.columns})
    return fill_features(df)


def model_features(df: DataFrame) -> list[str]:
    """Numeric inputs the frame has, frequency columns last."""
    return existing(df, [*fv.NUMERIC_FEATURES, *(f"{c}_freq" for c in fv.FREQUENCY_FEATURES)])


def with_split(df: DataFrame, key_cols=("train_no", "stop_seq"), pct: int = 80, seed: int = 42, name: str = "is_train"):
    """A flag true for ``pct`` percent of the row keys, the same on every run."""
    bucket = hash_int(row_key(key_cols, seed), 2) % 100
    return df.withColumn(name, bucket < pct)


def hash_split(df: DataFrame, key_cols=("train_no", "stop_seq"), pct: int = 80, seed: int = 42):
    """(train, test) by hash of the row key."""
    flagged = with_split(df, key_cols, pct, seed, "_in")
    return flagged.where("_in").drop("_in"), flagged.where("NOT _in").drop("_in")


def date_split(df: DataFrame, date_col: str, first_test_day):
    """(train, test) with every test row on or after a day; rows without a date are for training."""
    later = F.coalesce(F.col(date_col) >= F.lit(first_test_day), F.lit(False))
    return df.where(~later), df.where(later)


def stratified_cap(
    df: DataFrame,
    label: str = "arrival_delay_min",
    threshold: float = fv.MAJOR_DELAY_MIN,
    cap: int = fv.TRAIN_ROWS,
    key_cols=("train_no", "stop_seq"),
    seed: int = 42,
) -> DataFrame:
    """A sample of at most ``cap`` rows: four fifths minor delays, one fifth major ones."""
    delay = F.col(label)
    caps = [(delay <= threshold, int(cap * 0.8)), (delay > threshold, int(cap * 0.2))]
    return smallest_by_hash(df, row_key(key_cols, seed), caps)


def hash_sample(
    df: DataFrame,
    key_cols=("train_no", "stop_seq"),
    fraction: float = fv.EXPLAIN_FRACTION,
    cap: int = fv.EXPLAIN_ROWS,
    seed: int = 42,
) -> DataFrame:
    """A uniform sample of a fraction of the rows, at most ``cap`` of them."""
    key = row_key(key_cols, seed)
    chosen = hash_int(key, 3) < F.lit(int(fraction * 2**32))
    return smallest_by_hash(df, key, [(chosen, cap)])


def capped(df: DataFrame, n: int, key_cols, seed: int = 42) -> DataFrame:
    """At most ``n`` rows, chosen by hash of the key."""
    return smallest_by_hash(df, row_key(key_cols, seed), [(F.lit(True), n)])


def request_features(requests: DataFrame, history: DataFrame, default: int = fv.REQUEST_FREQUENCY) -> DataFrame:
    """Model inputs for requests that name little more than a train, a station and an hour.

    History counts come by join, ``default`` where the history has no such key; columns the
    request lacks or leaves null take the request defaults.
    """
    out = requests
    for c in fv.FREQUENCY_FEATURES:
        counts = aside(history.groupBy(c).agg(F.count(F.lit(1)).cast("double").alias(f"{c}_freq")), [c])
        out = out.join(counts, same(out, counts, [c]), "left").drop(f"_r_{c}")
        out = out.withColumn(f"{c}_freq", F.coalesce(f"{c}_freq", F.lit(float(default))))
    filled = {
        c: F.coalesce(F.col(c), F.lit(v)) if c in out.columns else F.lit(v)
        for c, v in fv.REQUEST_DEFAULTS.items()
    }
    return out.withColumns(filled).withColumns(
        {
            "is_peak_hour": is_peak(F.col("scheduled_hour"), fv.PEAK_REQUEST),
            "is_junction": is_junction(F.col("station_code")),
        }
    )
