"""Randomness that depends on a row's key and nothing else.

Results stay the same however the rows are partitioned and however often a task
is run again, which a seeded generator does not promise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 4294967296


def row_key(columns, seed: int = 42) -> Column:
    """Text key of a row; a null part reads as an empty one."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return F.concat_ws("|", *parts, F.lit(str(seed)))


def hash_int(key: Column, part: int = 0) -> Column:
    """One of the four 32-bit integers in the key's md5."""
    return F.conv(F.substring(F.md5(key), 8 * part + 1, 8), 16, 10).cast("long")


def standard_normal(key: Column) -> Column:
    """Box-Muller over two hash integers."""
    u1 = (hash_int(key, 0) + 1) / F.lit(float(SPAN + 1))
    u2 = hash_int(key, 1) / F.lit(float(SPAN))
    return F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2 * math.pi) * u2)
