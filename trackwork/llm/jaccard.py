"""Grouped prefix join on word shingles (operator 3).

Order all shingles by how many documents hold them, rarest first. Two similar documents share a
shingle among their first few in that order, their prefixes, and the places of the first shared one
bound the overlap. Documents with equal sets are one class; classes of equal prefix and size are one
group. Groups that share a prefix shingle are candidates.

Links only matter for what they connect, so pairs are found in two rounds. First every group is
compared with one group of each bucket (the one where the shingle comes earliest, which has the
fewest shingles of its own). Then only pairs of different components go on. A thousand copies with
small changes thus cost a thousand comparisons and not half a million.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackwork.llm.components import components
from trackwork.llm.shingles import shingle_set
from trackwork.llm.sketches import only_likely, summed
from trackwork.llm.tables import discard, in_batches, written
from trackwork.llm.tokens import slices

#: Buckets of the document counts; 1 MB whatever the input. Counts only order the shingles.
COUNT_BITS = 18


class Similarity(NamedTuple):
    """Shingles of ``words`` words; a link has ``of * shared >= share * united``."""

    words: int = 5
    share: int = 80
    of: int = 100

    def prefix(self, n: int) -> int:
        return n + self.share * n // -self.of + 1

    def reachable(self, n: Column, at: Column, m: Column, place: Column) -> Column:
        """Whether sets of n and m can link if the first shared shingle has these places."""
        n, at, m, place = (c.cast("bigint") for c in (n, at, m, place))
        most = F.least(n - at, m - place)
        return most * (self.of + self.share) >= (n + m) * self.share


def document_counts(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """Documents per bucket of shingle hashes."""

    def count(batches):
        total = np.zeros(1 << COUNT_BITS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch):
                sets = [shingle_set(value.as_py(), size) for value in part.column(0)]
                places = np.concatenate(sets) >> np.uint64(64 - COUNT_BITS)
                total += np.bincount(places.astype(np.int64), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    texts = in_batches(docs.select(F.col(text).cast("binary")))
    found = summed(texts.mapInArrow(count, "counts binary"), "i8")
    return np.zeros(1 << COUNT_BITS, dtype=np.int64) if found is None else found


def prefixes(docs: DataFrame, id_column: str, text: str, like: Similarity) -> DataFrame:
    """Per document: doc, text_hash, n, digest of its set, prefix, digest of the prefix, counts (see ``may_link``), v: a number."""
    order = docs.sparkSession.sparkContext.broadcast(document_counts(docs, text, like.words))
    names = ["doc", "text_hash", "n", "digest", "prefix", "prefix_digest", "counts"]

    def first_ones(batches):
        counts = order.value
        for batch in batches:
            sizes, digests, heads, head_digests, spread = [], [], [], [], []
            for value in batch.column(1):
                own = shingle_set(value.as_py(), like.words)
                rarest = own[np.argsort(counts[own >> np.uint64(64 - COUNT_BITS)], kind="stable")]
                head = rarest[: like.prefix(len(own))] if len(own) else own
                sizes.append(len(own))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                heads.append(head)
                head_digests.append(xxhash.xxh3_128_digest(head.tobytes()))
                spread.append(np.bincount(own.view(np.uint8)[::8], minlength=256).clip(max=255).astype(np.uint8).tobytes())
            offsets = np.cumsum([0, *map(len, heads)])
            values = np.concatenate([np.empty(0, dtype=np.uint64), *heads]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))
            made = [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists, pa.array(head_digests, pa.binary()), pa.array(spread, pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=names)

    schema = "doc bigint, text_hash bigint, n bigint, digest binary, prefix array<bigint>, prefix_digest binary, counts binary"
    value = F.col(text).cast("string")
    rows = docs.select(F.col(id_column).cast("bigint"), value.cast("binary"), F.xxhash64(value))
    return in_batches(rows).mapInArrow(first_ones, schema).withColumn("v", F.monotonically_increasing_id())


def classes_in_groups(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct sets as (v, doc, text_hash, n, digest, g): number, smallest id with its text, size, digest, group; groups as (g, n, prefix, several: of more than one class); counts by v.

    ``found`` is stored: prefixes and counts stay there, and only numbers and digests are grouped.
    """
    sets = found.where("n > 0 and doc is not null").groupBy("n", "digest")
    sets = sets.agg(F.min(F.struct("doc", "text_hash")).alias("of"), F.first("prefix_digest").alias("key"), F.min("v").alias("v"))
    sets = written(sets.select("v", "of.*", "n", "digest", "key"), "classes")
    groups = sets.groupBy("n", "key").agg(F.min("v").alias("g"), (F.count(F.lit(1)) > 1).alias("several"))
    members = written(sets.join(groups, ["n", "key"]).drop("key"), "members")
    heads = found.select("v", "n", "prefix").join(members.where("v = g").select("v", "several"), "v").withColumnRenamed("v", "g")
    return members.drop("several"), heads, found.select("v", "n", "counts")


def may_link(pairs: DataFrame, counts: DataFrame, like: Similarity) -> DataFrame:
    """Pairs that the counts of their shingles in 256 buckets do not rule out.

    What two sets share is at most the sum of the smaller counts. A count of 255 stands for more.
    """

    @F.pandas_udf("boolean")
    def close(n: pd.Series, m: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        left, right = (np.frombuffer(b"".join(side), dtype=np.uint8).reshape(-1, 256) for side in (x, y))
        least = np.minimum(left, right).astype(np.int64)
        shared = least.sum(axis=1) + (least == 255).any(axis=1) * (1 << 40)
        return pd.Series(shared * (like.of + like.share) >= (n.to_numpy() + m.to_numpy()) * like.share)

    pairs = written(pairs, "candidates")
    counts = only_likely(counts, "v", pairs.select("a").union(pairs.select("b")))
    both = pairs.join(counts.toDF("a", "n", "x"), "a").join(counts.toDF("b", "m", "y"), "b")
    return both.where(close("n", "m", "x", "y")).select("a", "b")


def buckets(heads: DataFrame, like: Similarity) -> DataFrame:
    """Places of prefix shingles that several groups share, each with the bucket's centre and size.

    Of a bucket of two only the pair is of use, and only if it can link. Where one of the two has several
    classes, round one compares not all of them, and the bucket is ``open`` for round two as larger ones are.
    """
    # One shuffle of three numbers serves both the centres and the join with them.
    packed = F.shiftleft(F.col("n"), 32) + F.shiftleft(F.col("at").cast("bigint"), 1) + F.col("several").cast("bigint")
    places = heads.select("g", "n", "several", F.posexplode("prefix").alias("at", "s"))
    dealt = places.select("s", "g", packed.alias("place")).repartition("s")
    at = F.shiftright("place", 1).bitwiseAND(F.lit((1 << 31) - 1))
    places = dealt.select("s", "g", F.shiftright("place", 32).alias("n"), at.cast("int").alias("at"), (F.col("place") % 2 == 1).alias("several"))
    rank = F.shiftleft(F.col("at").cast("bigint"), 40) + F.pmod(F.xxhash64("g"), F.lit(1 << 40))
    centres = places.withColumn("rank", rank).groupBy("s")
    centres = centres.agg(
        ((F.count(F.lit(1)) > 2) | F.max("several")).alias("open"),
        F.count(F.lit(1)).alias("size"),
        F.min_by("g", "rank").alias("centre"),
        F.min_by("n", "rank").alias("centre_n"),
        F.shiftright(F.min("rank"), 40).alias("centre_at"),
    )
    fits = like.reachable(F.col("n"), F.col("at"), F.col("centre_n"), F.col("centre_at"))
    shared = places.drop("several").join(centres.where("size > 1").drop("size"), "s").withColumn("fits", fits & (F.col("g") != F.col("centre")))
    return written(shared.where("fits or open").drop("centre_n", "centre_at"), "buckets")


def links(pairs: DataFrame, members: DataFrame, docs: DataFrame, id_column: str, text: str, like: Similarity) -> DataFrame:
    """Pairs (a, b) of classes whose whole sets are similar enough."""
    pairs = written(pairs, "pairs")
    needed = pairs.select("a").union(pairs.select("b")).distinct().toDF("v")
    needed = written(members.join(needed, "v").select("v", "doc", "text_hash", "digest"), "needed")

    def whole_sets(batches):
        for batch in batches:
            owners, sets = [], []
            for i, (value, digest) in enumerate(zip(batch.column(1), batch.column(2))):
                own = shingle_set(value.as_py(), like.words)
                if xxhash.xxh3_128_digest(own.tobytes()) == digest.as_py():  # texts of one hash may differ
                    owners.append(i)
                    sets.append(own.view(np.int64))
            kept = batch.column(0).take(pa.array(owners, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept, pa.array(sets, pa.list_(pa.int64()))], names=["v", "own"])

    value = F.col(text).cast("string")
    texts = docs.select(F.col(id_column).cast("bigint").alias("doc"), F.xxhash64(value).alias("text_hash"), value.cast("binary").alias("text"))
    # By id and text: an id may have many texts, a text many ids.
    texts = only_likely(texts, "doc", needed.select("doc")).join(needed, ["doc", "text_hash"])
    sets = in_batches(texts.select("v", "text", "digest")).mapInArrow(whole_sets, "v bigint, own array<bigint>")
    sets = written(sets.dropDuplicates(["v"]), "sets")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    linked = written(both.where(shared * (like.of + like.share) >= (F.size("x") + F.size("y")) * like.share).select("a", "b"), "links")
    for done in (pairs, needed, sets):
        discard(done)
    return linked


def with_roots(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Classes with the root of their component; those without links are their own."""
    found = components(edges)
    return members.join(found, "v", "left").withColumn("root", F.coalesce("root", "v"))


def first_pairs(members: DataFrame, shared: DataFrame) -> DataFrame:
    """Every class against the first class of its group and of each bucket's centre."""
    near = shared.where("fits").select("g", F.col("centre").alias("b")).distinct()
    own = members.where("v <> g").select(F.col("v").alias("a"), F.col("g").alias("b"))
    return members.join(near, "g").select(F.col("v").alias("a"), "b").union(own)


def open_pairs(members: DataFrame, shared: DataFrame, like: Similarity) -> DataFrame:
    """Pairs of classes of different components whose groups may hold similar sets."""
    spans = members.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    # A group of several components is like no other group.
    roots = spans.select("g", F.expr("if(low = high, low, -1 - g)").alias("root"))
    places = shared.where("open").select("s", "g", F.col("n").cast("int"), "at").join(roots, "g")
    several = places.groupBy("s").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    places = written(places.join(several.where("low < high").select("s"), "s"), "open")
    x, y = places.alias("x"), places.alias("y")
    fits = like.reachable(F.col("x.n"), F.col("x.at"), F.col("y.n"), F.col("y.at"))
    pairs = x.join(y, (F.col("x.s") == F.col("y.s")) & F.expr("x.g < y.g and x.root <> y.root") & fits)
    pairs = pairs.select(F.col("x.g").alias("g"), F.col("y.g").alias("h")).distinct()
    pairs = pairs.union(spans.where("low < high").select("g", F.col("g").alias("h")))
    a = members.select(F.col("v").alias("a"), "g", F.col("root").alias("ra"))
    b = members.select(F.col("v").alias("b"), F.col("g").alias("h"), F.col("root").alias("rb"))
    return pairs.join(a, "g").join(b, "h").where("ra <> rb and (g <> h or a < b)").select("a", "b")


def jaccard_components(docs: DataFrame, like: Similarity = Similarity(), id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, text_hash) of every row; component_id is the smallest id that links reach.

    Exact for any data: every pair that could link is compared unless its ends are already connected.
    A null or empty text has no shingles and no links. Rows with a null id are returned without a
    component and link with nothing. Rows that repeat an id are compared each by its own text. Ids are
    whole numbers; an empty table gives none; columns other than id and text are not read.
    """
    found = written(prefixes(docs, id_column, text, like), "prefixes")
    members, heads, counts = classes_in_groups(found)
    shared = buckets(heads, like)
    tested = written(first_pairs(members, shared).distinct(), "tested")
    rooted = written(with_roots(members, links(may_link(tested, counts, like), members, docs, id_column, text, like)), "rooted")
    either = tested.union(tested.select("b", "a"))
    rest = open_pairs(rooted, shared, like).join(either, ["a", "b"], "left_anti")
    more = links(may_link(rest, counts, like), members, docs, id_column, text, like)
    ends = rooted.select("v", "root")
    more = more.join(ends.toDF("a", "ra"), "a").join(ends.toDF("b", "rb"), "b")
    joined = components(more.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).toDF("root", "_top")
    tops = rooted.join(joined, "root", "left").withColumn("top", F.coalesce("_top", "root"))
    tops = written(tops.select("n", "digest", "doc", "top"), "tops")
    smallest = tops.groupBy("top").agg(F.min("doc").alias("component_id"))
    named = tops.join(smallest, "top").select("n", "digest", "component_id")
    out = found.select("doc", "text_hash", "n", "digest").join(named, ["n", "digest"], "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc"))
    return out.select(F.col("doc").alias(id_column), F.col("n").alias("n_shingles"), component.alias("component_id"), "text_hash")
