"""Approximate top-k retrieval: random hyperplanes, several tables, and the likeliest other buckets of each.

A chunk is in one bucket of every table: the sides of the table's planes it lies on. A query looks into its own bucket
and, in order of likelihood, into those across the planes it is close to. What is found is scored exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwork.functions.vectors import inner_product, l2_normalize
from trackwork.operators.retrieval import CHUNK_BLOCK, NOISE_DIGITS, QUERY_BLOCK, SCORE_DIGITS, best_of, trim, unit_rows
from trackwork.operators.skew import top_per_group
from trackwork.session import scratch_path
from trackwork.sinks.tables import write_table

TABLES, BITS, PROBES, SEED = 16, 10, 32, 42


def planes(tables: int, bits: int, dim: int, seed: int) -> np.ndarray:
    """Normals of the planes, the same for all tasks and runs."""
    return np.random.default_rng(seed).normal(size=(tables * bits, dim))


def bucketed(rows: DataFrame, key: str, tables: int, bits: int, probes: int, seed: int) -> DataFrame:
    """(key, slot, bucket): the ``probes`` likeliest buckets of each row in every table (slot)."""
    subsets = (np.arange(1 << bits)[:, None] >> np.arange(bits)) & 1
    flips = (subsets << np.arange(bits)).sum(axis=1)

    @F.pandas_udf("array<int>")
    def codes(vectors: pd.Series) -> pd.Series:
        if vectors.empty:
            return pd.Series([], dtype=object)
        units = unit_rows(vectors)
        side = (units @ planes(tables, bits, units.shape[1], seed).T).reshape(len(units), tables, bits)
        own = ((side > 0) << np.arange(bits)).sum(axis=2)
        if probes == 1:
            return pd.Series(list(own.astype(np.int32)))
        # A bucket is the less likely the farther the planes are that lie between.
        far = (side * side) @ subsets.T
        likely = np.argsort(far, axis=2, kind="stable")[:, :, :probes]
        return pd.Series(list((own[:, :, None] ^ flips[likely]).reshape(len(units), -1).astype(np.int32)))

    spread = rows.select(key, F.posexplode(codes("vector")).alias("i", "bucket"))
    return spread.select(key, F.floor(F.col("i") / probes).cast("int").alias("slot"), "bucket")


def build_lsh(chunks: DataFrame, tables: int = TABLES, bits: int = BITS, seed: int = SEED) -> DataFrame:
    """The index of ``chunks`` (chunk_id, vector): slot, bucket, chunk_id, sorted by bucket."""
    known = chunks.where(F.col("vector").isNotNull())
    index = bucketed(known, "chunk_id", tables, bits, 1, seed).repartitionByRange("slot", "bucket")
    return write_table(index.sortWithinPartitions("slot", "bucket"), scratch_path(chunks.sparkSession, "lsh"))


def layout(looked: DataFrame, index: DataFrame, chunk_block: int, query_block: int) -> DataFrame:
    """(slot, bucket, _first, _chunk_parts, _query_parts): the groups of buckets that one task compares.

    Neighbouring buckets of a table share a group while it stays small; a bucket too large for one is
    cut into parts on both sides. Rows are counted per bucket, ``tables * 2**bits`` at most.
    """
    asked = looked.groupBy("slot", "bucket").agg(F.count(F.lit(1)).alias("q"))
    held = index.groupBy("slot", "bucket").agg(F.count(F.lit(1)).alias("c"))
    both = sorted(asked.join(held, ["slot", "bucket"]).select("slot", "bucket", "q", "c").collect())
    rows, free, open_ = [], 0, None
    for slot, bucket, q, c in both:
        q_parts, c_parts = -(-q // query_block), -(-c // chunk_block)
        if open_ and q_parts * c_parts == 1 and open_[1] == slot and open_[2] + q <= query_block and open_[3] + c <= chunk_block:
            open_ = (open_[0], slot, open_[2] + q, open_[3] + c)
            rows.append((slot, bucket, open_[0], 1, 1))
            continue
        rows.append((slot, bucket, free, c_parts, q_parts))
        open_ = (free, slot, q, c) if q_parts * c_parts == 1 else None
        free += q_parts * c_parts
    return looked.sparkSession.createDataFrame(rows, "slot int, bucket int, _first long, _chunk_parts int, _query_parts int")


def best_in_buckets(queries: DataFrame, chunks: DataFrame, looked: DataFrame, index: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, score): the k best of what every query meets in each group of buckets, by block products."""
    groups = F.broadcast(groups)  # a row per bucket
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    met = looked.join(groups, ["slot", "bucket"]).withColumn("_o", numbers("_chunk_parts"))
    met = met.withColumn("_g", F.col("_first") + F.col("_o") * F.col("_query_parts") + part("query_id", "_query_parts"))
    met = met.groupBy("query_id", "_g").agg(F.collect_set("bucket").alias("_buckets")).join(queries.select("query_id", "vector"), "query_id")
    held = index.join(groups, ["slot", "bucket"]).withColumn("_o", numbers("_query_parts"))
    held = held.withColumn("_g", F.col("_first") + part("chunk_id", "_chunk_parts") * F.col("_query_parts") + F.col("_o"))
    held = held.select("chunk_id", "bucket", "_g").join(chunks.select("chunk_id", "vector"), "chunk_id")
    kinds = {f.name: f.dataType.simpleString() for df in (queries, chunks) for f in df.schema}

    def pair(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        nothing = pd.DataFrame({"query_id": [], "chunk_id": [], "score": []})
        if q.empty or c.empty:
            return nothing
        asked, known = unit_rows(q["vector"]), unit_rows(c["vector"])
        query_ids, chunk_ids = q["query_id"].to_numpy(), c["chunk_id"].to_numpy()
        owner, wanted = np.repeat(np.arange(len(q)), q["_buckets"].map(len)), np.concatenate(q["_buckets"].to_list())
        owner, wanted = owner[np.argsort(wanted, kind="stable")], np.sort(wanted)
        place = np.argsort(c["bucket"].to_numpy(), kind="stable")
        buckets, starts = np.unique(c["bucket"].to_numpy()[place], return_index=True)
        found = []
        for bucket, own in zip(buckets, np.split(place, starts[1:])):
            some = owner[np.searchsorted(wanted, bucket) : np.searchsorted(wanted, bucket, side="right")]
            if len(some):
                found.append(best_of(query_ids[some], asked[some], chunk_ids[own], known[own], k))
        return trim(pd.concat(found, ignore_index=True), k) if found else nothing

    by_group = met.select("query_id", "vector", "_buckets", "_g").groupBy("_g").cogroup(held.groupBy("_g"))
    return by_group.applyInPandas(pair, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double")


def approximate_top_k(
    queries: DataFrame,
    chunks: DataFrame,
    k: int = 4,
    index: DataFrame | None = None,
    tables: int = TABLES,
    bits: int = BITS,
    probes: int = PROBES,
    seed: int = SEED,
    chunk_block: int = CHUNK_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """Most of the k chunks with the highest cosine per query: query_id, chunk_id, score, rank.

    Shapes, null vectors and ties as in the exact search, scores are exact; only chunks in the buckets looked into
    are compared. ``index`` is from ``build_lsh`` with the same ``tables``, ``bits`` and ``seed``. More probes or
    tables find more. Vectors of one dimension; a query in whose buckets nothing lies has no rows. Buckets are
    compared in groups of at most ``chunk_block`` by ``query_block`` rows, and k hits a query leave each.
    """
    if not 1 <= probes <= 1 << bits:
        raise ValueError("a table has from 1 to 2**bits buckets to look into")
    index = build_lsh(chunks, tables, bits, seed) if index is None else index
    asked = queries.where(F.col("vector").isNotNull())
    looked = bucketed(asked, "query_id", tables, bits, probes, seed)
    groups = layout(looked, index, chunk_block, query_block)
    hits = best_in_buckets(asked, chunks, looked, index, groups, k)
    hits = hits.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))  # met in several tables
    pairs = top_per_group(hits, ["query_id"], [F.desc("score"), "chunk_id"], k).select("query_id", "chunk_id")
    unit = lambda df, key, name: df.select(key, l2_normalize(F.transform("vector", lambda x: x.cast("double"))).alias(name))
    scored = pairs.join(unit(chunks, "chunk_id", "_c"), "chunk_id").join(unit(asked, "query_id", "_q"), "query_id")
    scored = scored.select("query_id", "chunk_id", F.round(inner_product(F.col("_q"), F.col("_c")), NOISE_DIGITS).alias("score"))
    ranked = top_per_group(scored, ["query_id"], [F.desc("score"), "chunk_id"], k)
    return ranked.withColumn("score", F.round("score", SCORE_DIGITS))


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """One row: results of the exact search, how many of them were found, and their share."""
    both = exact.join(found.select("query_id", "chunk_id", F.lit(1).alias("_hit")), ["query_id", "chunk_id"], "left")
    return both.agg(F.count(F.lit(1)).alias("wanted"), F.count("_hit").alias("found")).withColumn("recall", F.col("found") / F.col("wanted"))
