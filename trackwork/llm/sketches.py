"""Summaries of fixed size that tasks fill and combine: whatever the input, so many bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackwork.llm.tables import fresh

BLOOM_BITS = 1 << 24
BLOOM_PROBES = 3


def summed(rows: DataFrame, dtype: str, combine=np.add) -> np.ndarray | None:
    """Combine the arrays in the only (binary) column, a few at a time; None where there are no rows."""
    zero = (None, 0)

    def add(held, other):
        if not held[1] or not other[1]:
            return held if held[1] else other
        return combine(held[0], other[0]), 1

    arrays = rows.rdd.map(lambda row: (np.frombuffer(row[0], dtype=dtype), 1))
    return arrays.treeAggregate(zero, add, add, depth=3)[0]


def _probes(ids: np.ndarray) -> np.ndarray:
    from trackwork.llm.shingles import mixed

    first = mixed(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    second = mixed(first) | np.uint64(1)
    return np.stack([(first + second * np.uint64(i)) % np.uint64(BLOOM_BITS) for i in range(BLOOM_PROBES)])


def likely_in(rows: DataFrame, key: Column, wanted: DataFrame) -> Column:
    """Whether ``key`` (bigint, not null) may be in ``wanted``, a frame of one column.

    True for every key that is there and for a few others. The filter has 2 MB for any number of keys;
    with very many it says yes more often.
    """

    def fill(batches):
        import pyarrow as pa

        bits = np.zeros(BLOOM_BITS, dtype=bool)
        for batch in batches:
            bits[_probes(batch.column(0).to_numpy()).ravel()] = True
        packed = np.packbits(bits, bitorder="little").tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], names=["bits"])

    keys = wanted.toDF("key").where("key is not null")
    filled = summed(keys.mapInArrow(fill, "bits binary"), "u1", np.bitwise_or)
    if filled is None:
        return F.lit(False)
    shared = rows.sparkSession.sparkContext.broadcast(filled)

    @F.pandas_udf("boolean")
    def likely(ids):
        import pandas as pd

        at = _probes(ids.to_numpy())
        bits = shared.value[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)
        return pd.Series((bits & 1).all(axis=0))

    return likely(key)


def only_likely(rows: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose key may be in ``wanted``: all of those and a few more, which a join by the caller drops."""
    known = rows.where(F.col(column).isNotNull())
    return known.where(likely_in(rows, F.coalesce(F.col(column), F.lit(0)), wanted))


def without(docs: DataFrame, id_column: str, text: str, gone: DataFrame, single: DataFrame | None = None) -> DataFrame:
    """``docs`` less the rows named in ``gone`` (id, text_hash); of each row named in ``single`` one stays.

    Rows that a filter of fixed size rules out pass through where they are; only the others are joined,
    so that texts which stay do not move. Nulls in the id are equal to each other here.
    """
    names = gone.toDF("_id", "_hash").distinct()
    keys = names.select("_hash") if single is None else names.select("_hash").union(single.toDF("_id", "_hash").select("_hash"))
    own_hash, likely = fresh(docs, "text_hash"), fresh(docs, "likely")
    hashed = docs.withColumn(own_hash, F.xxhash64(F.col(text).cast("string")))
    marked = hashed.withColumn(likely, likely_in(docs, F.col(own_hash), keys))
    some = marked.where(F.col(likely))
    same = (some[own_hash] == names["_hash"]) & some[id_column].eqNullSafe(names["_id"])
    left = some.join(names, same, "left_anti")
    if single is not None:
        again = single.toDF("_id", "_hash").distinct()
        repeats = (left[own_hash] == again["_hash"]) & left[id_column].eqNullSafe(again["_id"])
        once = left.join(again, repeats, "left_semi").dropDuplicates([id_column, own_hash])
        left = left.join(again, repeats, "left_anti").unionByName(once)
    return marked.where(~F.col(likely)).unionByName(left).select(*docs.columns)
