"""Changes between two snapshots of a keyed table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Inserted, updated (new values) and deleted rows with their ``_change_type``.

    Null keys are equal to each other. A column that one snapshot lacks is null there.
    """
    values = [c for c in dict.fromkeys([*new.columns, *old.columns]) if c not in keys]
    types = {**{f.name: f.dataType for f in old.schema}, **{f.name: f.dataType for f in new.schema}}

    def packed(df: DataFrame, name: str) -> DataFrame:
        """Keys and one struct of all columns, null where this snapshot lacks one."""
        row = F.struct(*((F.col(c) if c in df.columns else F.lit(None)).cast(types[c]).alias(c) for c in values))
        return df.select(F.struct(*keys).alias(f"{name}_key"), row.alias(name))

    before, after = packed(old, "_old"), packed(new, "_new")
    same = reduce(lambda a, b: a & b, (before[f"_old_key.{k}"].eqNullSafe(after[f"_new_key.{k}"]) for k in keys))
    both = before.join(after, same, "full_outer")
    key = F.coalesce("_new_key", "_old_key")
    changed = reduce(
        lambda a, b: a | b,
        (~F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}")) for c in values),
        F.lit(False),
    )
    kind = (
        F.when(F.col("_old").isNull(), "insert")
        .when(F.col("_new").isNull(), "delete")
        .when(changed, "update")
    )
    row = F.coalesce("_new", "_old")
    return (
        both.withColumn("_change_type", kind)
        .where(F.col("_change_type").isNotNull())
        .select(*(key[k].alias(k) for k in keys), *(row[c].alias(c) for c in values), "_change_type")
    )
