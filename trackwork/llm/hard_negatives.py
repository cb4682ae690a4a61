"""Hard negatives by coordinate pruning (operator 13).

Candidates lie in buckets of like length, each with a sorted list of every coordinate of its unit
vectors. A threshold on an anchor's product with them bounds the angle, by the bucket's greatest length,
and the angle bounds each coordinate: a range around the anchor's own. The ranges of the anchor's
largest (focus) coordinates are looked up in the sorted lists and intersected; what is left is verified
with the exact product. A bucket too short for the threshold is skipped whole.

Candidates stay where their length puts them; anchors, in small blocks, pass by them as a stream.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackwork.llm.tables import in_batches, kind, written

#: Rows of a bucket, buckets of a task, anchors of a block, rows that give the first thresholds.
BUCKET, HELD, ANCHORS, SEEDS = 4096, 8, 256, 2048
#: Components of a bucket and of a block of anchors, so that longer vectors make smaller ones.
BUCKET_SIZE, ANCHORS_SIZE = 1 << 18, 1 << 16
#: Focus coordinates of an anchor; where their shortest range holds more than this share, all rows are verified.
FOCUS, WORTH = 4, 0.5
#: More than doubles lose in an angle.
SLACK = 1e-9
#: Lengths up to which sums of products are exact in double precision, and fit a long.
EXACT, LIMIT = 2.0**53, 2.0**31
_EVERY, _NEVER = -(2**63) + 1, 2**62
_BLOCK = "part bigint, anchors boolean, seq bigint, dim int, ids binary, labels binary, vectors binary, extra binary"
_FOUND = "owner bigint, slot int, id bigint, score bigint"


def scaled_rows(vectors: DataFrame, asks: Column, id_column: str, vector: str, label: Column, scale: int) -> DataFrame:
    """(row, id, label, v, dim, length, asks) of the rows that take part."""
    number = lambda x: x.cast("double")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) < float("inf")))
    known = vectors.where(F.col(id_column).isNotNull() & label.isNotNull() & F.col(vector).isNotNull() & finite)
    whole = F.transform(vector, lambda x: F.floor(scale * F.greatest(F.least(number(x), F.lit(LIMIT)), F.lit(-LIMIT))))
    names = F.col(id_column).cast("bigint").alias("id"), label.cast("bigint").alias("label")
    rows = known.select(*names, whole.alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + number(x) * number(x)))
    rows = rows.withColumns({"dim": F.size("v"), "length": length}).where(F.col("length") < LIMIT)
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "scaled")


def _matrix(rows: pa.ListArray) -> np.ndarray:
    return rows.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(rows), -1)


def blocks(rows: DataFrame, most: int, components: int, per_part: int, anchors: bool) -> DataFrame:
    """Rows packed in order of length, longest first: ``most`` vectors of one dimension or fewer, if they are long."""
    count, dim = rows.agg(F.count(F.lit(1)), F.max("dim")).first()
    size = max(1, min(most, components // max(dim or 1, 1)))
    packs = max(1, -(-count // size))
    parts = max(-(-packs // per_part), min(packs, rows.sparkSession.sparkContext.defaultParallelism))
    order = ["dim", F.col("length").desc(), "id", "row"]
    extra = ["extra"] if "extra" in rows.columns else []
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("row", "id", "label", "v", "dim", *extra)

    def pack(batches):
        from pyspark import TaskContext

        part, seq, held, count = TaskContext.get().partitionId(), 0, [], 0

        def full(table):
            nonlocal seq
            dims = table.column("dim").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for start, end in zip(cuts, cuts[1:]):
                own = table.slice(start, end - start)
                v = _matrix(pa.concat_arrays(own.column("v").chunks))
                names = np.stack([own.column(n).to_numpy() for n in ("row", "id")]).astype(np.int64)
                more = np.stack(own.column("extra").to_pylist()).astype(np.int64).tobytes() if extra else b""
                yield (part, anchors, seq, int(dims[start]), names.tobytes(), own.column("label").to_numpy().astype(np.int64).tobytes(), v.tobytes(), more)
                seq += 1

        def out(found):
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=[f.split()[0] for f in _BLOCK.split(", ")]
            )

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count >= size:
                table = pa.Table.from_batches(held)
                yield from (out([b]) for b in full(table.slice(0, size)))
                rest = table.slice(size)
                held, count = rest.to_batches(), rest.num_rows
        if count:
            yield from (out([b]) for b in full(pa.Table.from_batches(held)))

    return written(in_batches(ordered).mapInArrow(pack, _BLOCK), "blocks")


class Bucket:
    """A block of candidates with sorted coordinate lists."""

    def __init__(self, dim: int, names: bytes, labels: bytes, vectors: bytes):
        self.ids = np.frombuffer(names, dtype=np.int64).reshape(2, -1)[1]
        self.labels = np.frombuffer(labels, dtype=np.int64)
        self.v = np.frombuffer(vectors, dtype=np.int64).reshape(len(self.ids), dim)
        self.wide = self.v.astype(np.float64)
        lengths = np.sqrt((self.wide * self.wide).sum(axis=1))
        self.longest = float(lengths.max(initial=0.0))
        unit = np.divide(self.wide, lengths[:, None], out=np.zeros_like(self.wide), where=lengths[:, None] > 0)
        self.zero = np.flatnonzero(lengths == 0)
        self.order = np.argsort(unit, axis=0, kind="stable")
        self.sorted = np.take_along_axis(unit, self.order, axis=0)

    def products(self, queries: np.ndarray, rows=slice(None)) -> np.ndarray:
        """Exact integer products."""
        wide = queries.astype(np.float64)
        if float(np.sqrt((wide * wide).sum(axis=1)).max(initial=0.0)) * self.longest < EXACT:
            return (wide @ self.wide[rows].T).astype(np.int64)
        return queries @ self.v[rows].T

    def near(self, queries: np.ndarray, limits: np.ndarray):
        """(query, candidate rows or None for all of them) of the queries that may reach their limit here."""
        wide = queries.astype(np.float64)
        lengths = np.sqrt((wide * wide).sum(axis=1))
        reach = lengths * self.longest
        # The least cosine that reaches the limit; a limit of 0 or less asks nothing of the angle.
        cosine = np.where(limits > 0, np.divide(limits, reach, out=np.full(len(limits), np.inf), where=reach > 0), -1.0)
        for q in np.flatnonzero(cosine <= 1 + SLACK):
            if limits[q] <= 0:
                yield q, None
                continue
            unit = wide[q] / lengths[q]
            focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
            own, angle = np.arccos(np.clip(unit[focus], -1, 1)), np.arccos(min(cosine[q], 1.0))
            low = np.cos(np.minimum(np.pi, own + angle)) - SLACK
            high = np.cos(np.maximum(0.0, own - angle)) + SLACK
            ends = [(np.searchsorted(self.sorted[:, f], a, "left"), np.searchsorted(self.sorted[:, f], b, "right")) for f, a, b in zip(focus, low, high)]
            if min(b - a for a, b in ends) > WORTH * len(self.ids):
                yield q, None
                continue
            met = np.zeros(len(self.ids), dtype=np.int8)
            for f, (a, b) in zip(focus, ends):
                met[self.order[a:b, f]] += 1
            rows = np.flatnonzero(met == len(focus))
            if len(rows):
                yield q, rows


def kth(scores: np.ndarray, k: int) -> int:
    """The k-th greatest score, or less than any where there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else _EVERY


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


class Kept:
    """The k best of each (anchor, slot) of a block so far, between the slot's bounds."""

    def __init__(self, k: int, low: np.ndarray, high: np.ndarray, floor: np.ndarray):
        self.k, self.low, self.high = k, low, high
        self.limit = np.maximum(low, floor)
        self.found = {}

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        for slot in range(self.low.shape[1]):
            fits = (scores >= self.limit[q, slot]) & (scores <= self.high[q, slot])
            if not fits.any():
                continue
            own, value = ids[fits], scores[fits]
            if (q, slot) in self.found:
                own, value = (np.concatenate(x) for x in zip(self.found[q, slot], (own, value)))
            keep = best(own, value, self.k)
            self.found[q, slot] = own[keep], value[keep]
            self.limit[q, slot] = max(self.limit[q, slot], kth(value, self.k))


def search(tiles: DataFrame, k: int, same_label: bool) -> DataFrame:
    """(owner, slot, id, score): the k best of every anchor's slots among each part's candidates.

    A task reads its part's candidates, then the anchors' blocks one by one. A block's ``extra`` holds per anchor
    and slot: lower bound, upper bound, and a score that k candidates are known to reach.
    """

    def run(batches):
        part, buckets = None, []
        for batch in batches:
            for part_of, is_anchors, _, dim, names, labels, vectors, extra in zip(*(batch.column(i) for i in range(8))):
                if part_of.as_py() != part:
                    part, buckets = part_of.as_py(), []
                if not is_anchors.as_py():
                    buckets.append((dim.as_py(), Bucket(dim.as_py(), names.as_py(), labels.as_py(), vectors.as_py())))
                    continue
                owner, ids = np.frombuffer(names.as_py(), dtype=np.int64).reshape(2, -1)
                label = np.frombuffer(labels.as_py(), dtype=np.int64)
                v = np.frombuffer(vectors.as_py(), dtype=np.int64).reshape(len(ids), dim.as_py())
                low, high, floor = np.moveaxis(np.frombuffer(extra.as_py(), dtype=np.int64).reshape(len(ids), -1, 3), 2, 0)
                kept = Kept(k, low, high, floor)
                for bucket_dim, bucket in buckets:
                    if bucket_dim == dim.as_py():
                        _visit(bucket, v, ids, label, kept, same_label)
                rows = [(owner[q], slot, i, s) for (q, slot), found in kept.found.items() for i, s in zip(*found)]
                columns = list(zip(*rows)) or [[]] * 4
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["owner", "slot", "id", "score"])

    return in_batches(tiles).mapInArrow(run, _FOUND)


def _visit(bucket: Bucket, v, ids, label, kept: Kept, same_label: bool) -> None:
    everything = []
    limits = kept.limit.min(axis=1)

    def offer(q, rows, scores):
        fits = ((bucket.labels[rows] == label[q]) == same_label) & (bucket.ids[rows] != ids[q]) & (scores >= kept.limit[q].min())
        kept.add(q, bucket.ids[rows][fits], scores[fits])

    for q, rows in bucket.near(v, limits):
        if rows is None:
            everything.append(q)
        else:
            offer(q, rows, bucket.products(v[q : q + 1], rows)[0])
    for start in range(0, len(everything), 64):
        some = everything[start : start + 64]
        for q, scores in zip(some, bucket.products(v[some])):
            offer(q, slice(None), scores)


def _tiles(candidates: DataFrame, parts: int, anchors: DataFrame) -> DataFrame:
    """A partition per part: its candidates first, then every block of anchors."""
    passing = anchors.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    both = candidates.unionByName(passing).withColumn("place", F.col("part").cast("int"))
    dealt = both.repartitionById(parts, "place").sortWithinPartitions("part", "anchors", "seq")
    return dealt.drop("place")


def _seeds(rows: DataFrame, seeds: int):
    """At most ``seeds`` rows, chosen by hash: known scores, from which searches begin."""
    few = rows.orderBy(F.xxhash64("row", "id"), "row").limit(seeds).select("id", "label", "v").toPandas()
    out = {}
    for dim, own in few.groupby(few["v"].map(len)):
        out[dim] = own["id"].to_numpy(np.int64), own["label"].to_numpy(np.int64), np.stack(own["v"]).astype(np.int64).reshape(len(own), dim)
    return out


def _with_windows(anchors: DataFrame, shared, k: int, same_label: bool) -> DataFrame:
    """``extra`` from ``windows`` (pairs of bounds): the bounds, and what the seeds reach within them."""

    def fill(batches):
        for batch in batches:
            extra = []
            columns = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("id", "label", "v", "windows"))
            for own, label, v, windows in zip(*columns):
                ids, labels, known = shared.value.get(len(v), (None, None, None))
                found = np.empty(0, dtype=np.int64)
                if ids is not None:
                    fits = ((labels == label) == same_label) & (ids != own)
                    found = known[fits] @ np.asarray(v, dtype=np.int64)
                rows = [(w["low"], w["high"], kth(found[(found >= w["low"]) & (found <= w["high"])], k)) for w in windows]
                extra.append([x for row in rows for x in row])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(extra, pa.list_(pa.int64()))], names=[*batch.schema.names, "extra"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in anchors.schema)
    return written(in_batches(anchors).mapInArrow(fill, f"{schema}, extra array<bigint>"), "anchors")


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
    relabelled: Column | None = None,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    bucket: int = BUCKET,
    seeds: int = SEEDS,
) -> DataFrame:
    """Hard negatives of every anchor and each of its positives.

    Scores are integer products of components ``floor(scale * x)``. An anchor's positives are its best
    ``positives`` rows of the same label and another id; of the rows of another label (and id) with
    ``low * positive <= 100 * score <= high * positive`` the best ``negatives`` are returned: anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score. Ties go to smaller ids; a positive without
    such rows has none. Null ids, labels and vectors, null and non-finite components take no part, nor vectors
    that are 2^31 or longer when scaled, whose products a long may not hold. Vectors meet those of their own
    dimension. Rows that repeat an id are rows of their own; each of them that is an anchor has its own
    rows in the result. An empty table gives no rows; other columns are not read. ``relabelled`` is the
    label to use; ``bucket`` and ``seeds`` change speed, not results.
    """
    id_kind = kind(vectors, id_column)
    rows = scaled_rows(vectors, is_anchor, id_column, vector, F.col(label) if relabelled is None else relabelled, scale)
    asked = rows.where("asks")
    candidates = blocks(rows, bucket, BUCKET_SIZE, HELD, anchors=False)
    parts = (candidates.agg(F.max("part")).first()[0] or 0) + 1
    shared = rows.sparkSession.sparkContext.broadcast(_seeds(rows, seeds))
    window = lambda a, b: F.struct(a.cast("bigint").alias("low"), b.cast("bigint").alias("high"))

    def searched(anchors: DataFrame, k: int, same_label: bool, name: str) -> DataFrame:
        packed = blocks(_with_windows(anchors, shared, k, same_label), ANCHORS, ANCHORS_SIZE, 16, anchors=True)
        found = written(search(_tiles(candidates, parts, packed), k, same_label), name)
        order = Window.partitionBy("owner", "slot").orderBy(F.desc("score"), "id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    every = asked.withColumn("windows", F.array(window(F.lit(_EVERY), F.lit(2**63 - 1))))
    near = written(searched(every, positives, True, "near-positives").drop("slot"), "positives")
    share = lambda percent: percent * F.col("score").cast("decimal(20,0)") / 100
    bounds = near.select("owner", "rank", window(F.ceil(share(low)), F.floor(share(high))).alias("w"))
    nothing = window(F.lit(_NEVER), F.lit(0))
    bounds = bounds.withColumn("w", F.when(F.col("w.low") <= F.col("w.high"), F.col("w")).otherwise(nothing))
    listed = bounds.groupBy("owner").agg(F.array_sort(F.collect_list(F.struct("rank", "w"))).alias("listed"))
    padded = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get("listed.w", i), nothing))
    narrow = asked.join(listed.select(F.col("owner").alias("row"), padded.alias("windows")), "row")
    far = searched(narrow, negatives, False, "near-negatives")
    far = far.select("owner", (F.col("slot") + 1).alias("at"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = near.join(asked.select(F.col("row").alias("owner"), F.col("id").alias("anchor_id")), "owner")
    named = named.select("owner", F.col("rank").alias("at"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = named.join(far, ["owner", "at"])
    ids = [F.col(c).cast(id_kind).alias(c) for c in ("anchor_id", "positive_id", "negative_id")]
    return out.select(ids[0], ids[1], "rank", ids[2], "positive_score", "negative_score")


#: The query in DuckDB SQL, every pair scored.
MINE_SQL = """
WITH scaled AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
           CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM scaled a JOIN scaled b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT * FROM pairs WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id
WHERE NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""
