"""Exact nearest neighbours by a block matrix join (operator 6).

Vectors are scaled to length 1 and rounded to int8. A tile is the int8 product of a block of queries
and a block of candidates; the rounding errors' lengths bound how far a product is from the cosine.
Pairs whose upper bound stays below the k-th best lower bound cannot be results; the others are
computed again in double precision from the given vectors, and heaps keep the best of each query.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackwork.llm.tables import kind, written

BLOCK = 4096
#: Queries multiplied at a time; bounds the memory of a tile.
STRIP = 256
#: Numbers of the query vectors that are sent to the candidates at a time; bounds what the driver holds.
SENT_NUMBERS = 1 << 22
#: Above the rounding errors of double-precision sums of any usual length.
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """Neither null nor zero, without null or non-finite components."""
    number = lambda x: x.cast("double")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integers of at most 127 as float32, their scale, and the length of what rounding took."""
    units = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    units = units / np.sqrt((units * units).sum(axis=1, keepdims=True))
    scale = np.abs(units).max(axis=1, keepdims=True) / 127
    whole = np.rint(units / scale)
    lost = units - whole * scale
    return whole.astype(np.int8), scale[:, 0], np.sqrt((lost * lost).sum(axis=1))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row in double precision; equal rows give equal results wherever they stand."""
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1)))


def _product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact product of int8 blocks: sums stay below 2^24 for float32, else float64 is used."""
    wide = np.float32 if x.shape[1] <= 1024 else np.float64
    return (x.astype(wide) @ y.astype(wide).T).astype(np.float64)


def tile(queries: np.ndarray, candidates: np.ndarray, k: int, asking: np.ndarray, owner: np.ndarray):
    """Pairs of a tile that may be among the k best of their query: (query row, candidate row, score).

    A query takes no candidate whose ``owner`` is its ``asking``.
    """
    qx, sx, ex = quantised(queries)
    qy, sy, ey = quantised(candidates)
    for top in range(0, len(queries), STRIP):
        own = slice(top, top + STRIP)
        near = _product(qx[own], qy) * sx[own, None] * sy[None, :]
        room = ex[own, None] + ey[None, :] * (1 + ex[own, None]) + SLACK
        low = near - room
        barred = asking[own, None] == owner[None, :]
        low[barred] = -np.inf
        limit = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] >= k else np.full(len(low), -np.inf)
        rows, columns = np.nonzero((near + room >= limit[:, None]) & ~barred)
        for start in range(0, len(rows), 1 << 14):
            x, y = rows[start : start + (1 << 14)] + top, columns[start : start + (1 << 14)]
            yield x, y, cosines(queries[x], candidates[y])


def merged(found, queries: int, k: int) -> list[list[tuple[float, int]]]:
    """Heaps of the k best of each query, with all that tie for the last place."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(queries)]
    for rows, columns, scores in found:
        for q, column, score in zip(rows.tolist(), columns.tolist(), scores.tolist()):
            heap = heaps[q]
            if len(heap) < k or score >= heap[0][0]:
                heapq.heappush(heap, (score, column))
                while sum(s > heap[0][0] for s, _ in heap) >= k:
                    heapq.heappop(heap)
    return heaps


def _matrix(rows: pa.ListArray) -> np.ndarray:
    values = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(rows), -1)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int,
    id_column: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """The k nearest rows by cosine of every query row: query_id, rank (from 1), vec_id, score.

    Exact; ties go to the smaller id, and a row is never its own neighbour. Null, zero or non-finite
    vectors and null ids take no part; vectors are compared with those of the same length only. Rows
    that repeat an id are rows of their own as candidates, but not as neighbours of that id. Equal
    vectors meet the queries once: of each only the k + 1 smallest ids can be results, and those are
    joined at the end. A vector that only the query's own id holds is left out before anything is cut. An empty table gives no rows; other columns are not read.
    """
    id_kind = kind(vectors, id_column)
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("v", F.col("v").cast("array<double>"))
    # -0.0 and 0.0 are one value to a group, so equal keys are equal vectors.
    counted = rows.groupBy("v").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    distinct = written(counted.withColumn("c", F.monotonically_increasing_id()).withColumn("dim", F.size("v")), "vectors")
    # No id gives more than k results, and without any one id there are k among the k + 1 smallest.
    held = rows.groupBy("v", "id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("copies"))
    first = Window.partitionBy("v").orderBy("id")
    smallest = held.withColumn("at", F.row_number().over(first)).where(F.col("at") <= k + 1)
    holders = written(smallest.join(distinct.select("v", "c"), "v").select("c", "id", "copies"), "holders")
    # Ids that alone hold some vector have a number; only they need queries of their own.
    alone = distinct.where("low = high").select("c", F.col("low").alias("id"))
    owners = written(alone.groupBy("id").agg(F.min("c").alias("own")), "owners")
    # Compressed tables look smaller than they are: those with a row per vector are kept from being broadcast.
    offers = alone.join(owners.hint("merge"), "id").select("c", "own")
    offers = distinct.select("c", "dim", "v").join(offers, "c", "left").withColumn("own", F.coalesce("own", F.lit(-1)))
    queries = rows.where("q").select("v", "id").distinct().join(distinct.select("v", "c"), "v").join(owners.hint("merge"), "id", "left")
    queries = written(queries.select(F.col("id").alias("query_id"), "c", F.coalesce("own", F.lit(-2)).alias("own")), "queries")
    asks = queries.select("c", "own").distinct().join(distinct.select("c", "dim", "v"), "c")

    def packed(frame: DataFrame, rows: int) -> DataFrame:
        """(dim, block, rows) of about ``BLOCK`` vectors each, dealt by hash."""
        blocks = F.lit(max(1, -(-rows // BLOCK)))
        dealt = frame.select("dim", F.pmod(F.xxhash64("c", "own"), blocks).alias("block"), F.struct("c", "own", "v").alias("row"))
        return dealt.groupBy("dim", "block").agg(F.collect_list("row").alias("rows"))

    asking = asks.agg(F.count(F.lit(1)).alias("rows"), F.sum("dim").alias("numbers")).first()
    asked = packed(asks, asking["rows"]).toDF("dim", "asking", "queries")
    offered = packed(offers, offers.count()).toDF("dim", "offering", "candidates")
    # Blocks of candidates stay where they are; the queries come by, so many at a time that they can be sent.
    rounds = max(1, -(-(asking["numbers"] or 0) // SENT_NUMBERS))
    if rounds > 1:
        asked, offered = written(asked, "asked"), written(offered, "offered")

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                queries, candidates = (batch.column(c)[i].values for c in (0, 1))
                qc, cc = (side.field("c").to_numpy() for side in (queries, candidates))
                x, y = (_matrix(side.field("v")) for side in (queries, candidates))
                asking, owner = (side.field("own").to_numpy() for side in (queries, candidates))
                heaps = merged(tile(x, y, k, asking, owner), len(qc), k)
                found = [(qc[q], asking[q], cc[c], s) for q, heap in enumerate(heaps) for s, c in heap]
                columns = list(zip(*found)) or [[], [], [], []]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["qc", "own", "c", "score"])

    ranked = Window.partitionBy("qc", "own").orderBy(F.col("score").desc())

    def best(turn: int) -> DataFrame:
        sent = asked.where(F.pmod("asking", F.lit(rounds)) == turn) if rounds > 1 else asked
        tiles = offered.join(F.broadcast(sent), "dim").select("queries", "candidates")
        pairs = tiles.mapInArrow(search, "qc bigint, own bigint, c bigint, score double")
        # rank() keeps every vector tied with the last place: ids decide among those.
        return written(pairs.withColumn("place", F.rank().over(ranked)).where(F.col("place") <= k).drop("place"), "near")

    pairs = reduce(DataFrame.unionByName, (best(turn) for turn in range(rounds)))
    options = pairs.join(holders.hint("merge"), "c").select("qc", "own", "score", "id", "copies")
    # k of each id, then 2 k of all: whichever id asks, k of others are among them.
    by_id = Window.partitionBy("qc", "own", "id").orderBy(F.col("score").desc())
    options = options.withColumn("at", F.row_number().over(by_id)).where(F.col("at") <= k)
    by_query = Window.partitionBy("qc", "own").orderBy(F.col("score").desc(), "id")
    options = options.withColumn("at", F.row_number().over(by_query)).where(F.col("at") <= 2 * k).drop("at")
    out = queries.withColumnRenamed("c", "qc").join(options, ["qc", "own"]).where("id <> query_id")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    final = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    out = out.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.col("id").cast(id_kind).alias("vec_id"), "score")
