"""Exact top-k retrieval over words weighted by rarity.

A chunk is the vector of its words' counts times their rarity, scaled to length one. The index holds the
chunks' texts, every word's rarity, and what the rarer words add to each chunk's length; the commonest
words' rarities go to the tasks. Few queries go to the tasks as well: every chunk meets them where it is,
by the words they share, and a task keeps k hits per query. For more queries the index is inverted: a
posting per chunk and word, in ranges of words, and for every word its greatest weight anywhere. Such a
search takes a query's words from the rarest to the most common: the first find chunks whose scores give
a threshold, and the words from which on all that is left cannot reach it bring no candidates of their
own. The long postings of common words are so left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackwork.operators.retrieval import BROADCAST_QUERIES, NOISE_DIGITS, SCORE_DIGITS, trim
from trackwork.operators.skew import top_per_group
from trackwork.session import scratch_path
from trackwork.sinks.tables import write_table

#: Words first looked up, and chunks scored for each of the k wanted, to find a query's threshold.
FIRST_WORDS, FIRST_CHUNKS = 8, 4
#: Share of the threshold that words without candidates may add: the others' sums then leave few chunks to score.
LEFT_OUT = 0.25
#: More than sums of doubles lose.
SLACK = 1e-9
#: Words, the commonest, whose rarities go to every task; the others' postings are few and joined.
SENT_WORDS = 200_000
#: Different words of all queries together up to which the queries go to the chunks.
SENT_TERMS = 200_000
#: Chunks that a task scores at once.
SCORED_TOGETHER = 512


class Index(NamedTuple):
    """``texts`` (chunk_id, text, rare: squares of the weights of words not sent), ``rarities`` (term, idf), ``sent`` (term, idf)."""

    texts: DataFrame
    rarities: DataFrame
    sent: DataFrame
    unknown: float


class Inverted(NamedTuple):
    """``postings`` (term, chunk_id, weight) by ranges of terms; ``chunks`` (chunk_id, terms); ``terms`` (term, idf, top)."""

    postings: DataFrame
    chunks: DataFrame
    terms: DataFrame
    unknown: float


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def counted(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, n). Texts are dealt by key once; their words need not move."""
    dealt = df.select(key, F.col(text).alias("_text")).where(F.col(key).isNotNull()).repartition(key)
    return dealt.select(key, F.explode(words_of(F.col("_text"))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("n"))


def _length(weight: Column) -> Column:
    return F.sqrt(F.sum(weight * weight))


def _staged(df: DataFrame, name: str) -> DataFrame:
    return write_table(df, scratch_path(df.sparkSession, name))


def one_per_id(chunks: DataFrame, text_col: str) -> DataFrame:
    """(chunk_id, text): the texts of an id that repeats as one. Only such texts move."""
    known = chunks.select("chunk_id", F.col(text_col).alias("text")).where(F.col("chunk_id").isNotNull())
    again = known.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("chunk_id")
    again = _staged(again, "repeated-ids")
    if again.isEmpty():
        return known
    merged = known.join(again, "chunk_id", "left_semi").groupBy("chunk_id")
    merged = merged.agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    return known.join(again, "chunk_id", "left_anti").unionByName(merged)


def commonest(seen: DataFrame, most: int) -> DataFrame:
    """The words in so many chunks or more that there are at most ``most`` of them."""
    level = F.floor(F.log2("df")).cast("int")
    held = {r["level"]: r["n"] for r in seen.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()}  # 64 rows at most
    least, total = max(held, default=0) + 1, 0
    while least > 0 and total + held.get(least - 1, 0) <= most:
        least -= 1
        total += held.get(least, 0)
    return seen.where(level >= least)


def build_index(chunks: DataFrame, text_col: str = "text", sent_words: int = SENT_WORDS) -> Index:
    """The index of ``chunks`` (chunk_id, text). Chunks without words meet no query; texts of one id count as one.

    Texts move once, to meet what their rarer words add to their lengths, and not at all where every word is sent.
    """
    n_chunks = chunks.count()
    texts = one_per_id(chunks, text_col)
    words = words_of(F.col("text"))
    seen = texts.select(F.explode(F.array_distinct(words)).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    seen = _staged(seen.withColumn("idf", F.ln((n_chunks + 1) / (F.col("df") + 1))), "rarities")
    sent = _staged(commonest(seen, sent_words), "sent-words").select("term", "idf")
    rest = seen.join(F.broadcast(sent.select("term")), "term", "left_anti").select("term", "idf")
    if rest.isEmpty():
        texts = texts.withColumn("rare", F.lit(0.0))
    else:
        own = texts.select("chunk_id", F.explode(words).alias("term")).join(F.broadcast(sent.select("term")), "term", "left_anti")
        own = own.groupBy("chunk_id", "term").agg(F.count(F.lit(1)).alias("n")).join(rest, "term")
        squares = F.array_sort(F.collect_list(F.pow(F.col("n") * F.col("idf"), 2.0)))  # in one order, so that equal texts have equal sums
        rare = own.groupBy("chunk_id").agg(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x).alias("rare"))
        texts = texts.join(rare, "chunk_id", "left").withColumn("rare", F.coalesce("rare", F.lit(0.0)))
    return Index(_staged(texts, "chunk-texts"), seen.select("term", "idf"), sent, math.log(n_chunks + 1))


def inverted(index: Index) -> Inverted:
    """The same chunks by words, for searches with many queries."""
    counts = _staged(counted(index.texts, "chunk_id", "text"), "term-counts")
    weighted = counts.join(index.rarities, "term").select("chunk_id", "term", (F.col("n") * F.col("idf")).alias("w")).where("w > 0")
    whole = weighted.groupBy("chunk_id").agg(_length(F.col("w")).alias("length"), F.collect_list(F.struct("term", "w")).alias("terms"))
    scaled = F.transform("terms", lambda t: F.struct(t["term"].alias("term"), (t["w"] / F.col("length")).alias("weight")))
    vectors = _staged(whole.select("chunk_id", scaled.alias("terms")), "chunk-vectors")
    postings = vectors.select("chunk_id", F.explode("terms").alias("t")).select("t.term", "chunk_id", "t.weight")
    postings = _staged(postings.repartitionByRange("term").sortWithinPartitions("term"), "postings")
    tops = postings.groupBy("term").agg(F.max("weight").alias("top"))
    terms = _staged(index.rarities.join(tops, "term", "left").fillna(0.0, ["top"]), "terms")
    return Inverted(postings, vectors, terms, index.unknown)


def _weighed(counts: DataFrame, terms: DataFrame, unknown: float) -> DataFrame:
    """Counts of the queries' words with ``terms`` and ``weight``; a word no chunk has counts in the length."""
    known = counts.join(terms, "term", "left")
    known = known.withColumn("w", F.col("n") * F.coalesce("idf", F.lit(unknown)))
    every = Window.partitionBy("query_id")
    weight = F.col("w") / F.nullif(F.sqrt(F.sum(F.col("w") * F.col("w")).over(every)), F.lit(0.0))
    return known.withColumn("weight", weight).where("weight > 0")


def query_terms(queries: DataFrame, index: Index | Inverted) -> DataFrame:
    """(query_id, term, weight, at, rest): words from the rarest on; what they and all later ones can add at most."""
    terms = (index if isinstance(index, Inverted) else inverted(index)).terms
    known = _weighed(counted(queries, "query_id", "query_text"), terms, index.unknown)
    known = known.where("top > 0").withColumn("most", F.col("weight") * F.col("top"))
    order = Window.partitionBy("query_id").orderBy(F.desc("idf"), "term")
    later = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    # A sum of the greatest weights, or the length of what is left of the query, as chunks have length one.
    rest = F.least(F.sum("most").over(later), F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(later)))
    return known.select("query_id", "term", "weight", F.row_number().over(order).alias("at"), rest.alias("rest"))


def _scores(pairs: DataFrame, asked: DataFrame, index: Inverted) -> DataFrame:
    """Exact scores of (query_id, chunk_id), summed in the order of the query's words."""
    vector = asked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("at", "term", "weight"))).alias("q"))
    held = pairs.join(index.chunks, "chunk_id").join(vector, "query_id")
    own = F.map_from_entries("terms")
    dot = F.aggregate("q", F.lit(0.0), lambda total, x: total + x["weight"] * F.coalesce(F.element_at(F.col("own"), x["term"]), F.lit(0.0)))
    return held.withColumn("own", own).select("query_id", "chunk_id", F.round(dot, NOISE_DIGITS).alias("score"))


def search(
    queries: DataFrame, index: Index, k: int = 4, broadcast_queries: int = BROADCAST_QUERIES, sent_terms: int = SENT_TERMS
) -> DataFrame:
    """The k chunks with the highest cosine of rarity-weighted words: query_id, chunk_id, score, rank.

    ``queries`` has query_id, query_text. Exact, ties by chunk id; chunks that share no word of any rarity
    with a query are not among its results, so it may have fewer than k. A word no chunk has counts in
    the query's length; null and empty texts find nothing. Up to ``broadcast_queries`` queries of
    ``sent_terms`` different words are sent to the chunks; more are found from the inverted index.
    """
    counts = _staged(counted(queries, "query_id", "query_text"), "query-counts")
    if counts.count() <= sent_terms and counts.select("query_id").distinct().count() <= broadcast_queries:
        hits = _against_queries(counts, index, k)
    else:
        hits = _by_words(queries, inverted(index), k)
    ranked = top_per_group(hits, ["query_id"], [F.desc("score"), "chunk_id"], k)
    return ranked.select("query_id", "chunk_id", F.round("score", SCORE_DIGITS).alias("score"), "rank")


def _against_queries(counts: DataFrame, index: Index, k: int) -> DataFrame:
    """The k best chunks of every task for every query, by queries that are sent to the chunks."""
    known = index.rarities.join(F.broadcast(counts.select("term").distinct()), "term", "left_semi")
    asked = _weighed(counts, _staged(known, "query-rarities"), index.unknown).where("idf > 0")
    asked = asked.select("query_id", "term", "idf", "weight").toArrow()
    terms = asked.select(["term", "idf"]).group_by(["term", "idf"]).aggregate([]).sort_by([("idf", "descending"), ("term", "ascending")])
    place = {term: i for i, term in enumerate(terms["term"].to_pylist())}
    queries = asked["query_id"].combine_chunks().dictionary_encode()
    owner, ids = queries.indices.to_numpy(zero_copy_only=False), queries.dictionary
    at = np.array([place[term] for term in asked["term"].to_pylist()], dtype=np.int64)
    order = np.argsort(at, kind="stable")
    # The queries that have the word of place i: from starts[i] to starts[i + 1].
    starts = np.searchsorted(at[order], np.arange(len(place) + 1))
    parts = (place, terms["idf"].to_numpy(), starts, owner[order], asked["weight"].to_numpy()[order], ids)
    context = index.texts.sparkSession.sparkContext
    shared, rarity = context.broadcast(parts), context.broadcast(dict(index.sent.toPandas().itertuples(index=False, name=None)))
    kinds = {"query_id": counts.schema["query_id"].dataType.simpleString(), "chunk_id": index.texts.schema["chunk_id"].dataType.simpleString()}
    rows = index.texts.select("chunk_id", words_of(F.col("text")).alias("words"), "rare")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value[-1]
        least, best, kind = np.zeros(len(ids)), None, None
        for batch in batches:
            for start in range(0, batch.num_rows, SCORED_TOGETHER):
                part = batch.slice(start, SCORED_TOGETHER)
                kind = part.column(0).type
                scores = _shared_words(part, shared.value, rarity.value)
                keep = min(k, len(scores))
                limits = np.partition(scores, len(scores) - keep, axis=0)[len(scores) - keep]
                row, query = np.nonzero((scores > 0) & (scores >= np.maximum(limits, least)))
                if not len(row):
                    continue
                hits = pd.DataFrame({"query_id": query, "chunk_id": part.column(0).take(pa.array(row)).to_pandas(), "score": scores[row, query]})
                best = trim(hits if best is None else pd.concat([best, hits], ignore_index=True), k)
                full = best.groupby("query_id")["score"].agg(["size", "min"])
                full = full[full["size"] == k]
                least[full.index.to_numpy()] = full["min"].to_numpy()
        if best is not None:
            columns = [ids.take(pa.array(best["query_id"].to_numpy())), pa.array(best["chunk_id"].tolist(), kind), pa.array(best["score"].to_numpy())]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "chunk_id", "score"])

    return rows.mapInArrow(scan, f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double")


def _shared_words(part: pa.RecordBatch, asked: tuple, rarity: dict) -> np.ndarray:
    """Scores of the chunks (rows) for the queries (columns), each summed from the query's rarest word on."""
    place, idf, starts, owner, weight, ids = asked
    lists = part.column(1)
    coded = lists.flatten().dictionary_encode()
    known = coded.dictionary.to_pylist()
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
    held, n = np.unique(row * max(len(known), 1) + coded.indices.to_numpy(), return_counts=True)
    row, word = np.divmod(held, max(len(known), 1))
    w = n * np.array([rarity.get(term, 0.0) for term in known])[word] if known else np.empty(0)
    order = np.lexsort((w, row))  # in one order, so that equal texts have equal lengths
    length = np.sqrt(np.bincount(row[order], w[order] ** 2, len(lists)) + part.column(2).to_numpy())
    at = np.array([place.get(term, -1) for term in known], dtype=np.int64)[word] if known else word
    order = np.argsort(at, kind="stable")
    order = order[at[order] >= 0]
    row, at, n = row[order], at[order], n[order]
    own = n * idf[at] / length[row]
    times = starts[at + 1] - starts[at]
    again = np.repeat(np.arange(len(at)), times)
    met = np.arange(len(again)) - np.repeat(np.cumsum(times) - times, times) + starts[at][again]
    scores = np.bincount(row[again] * len(ids) + owner[met], weight[met] * own[again], len(lists) * len(ids))
    return np.round(scores, NOISE_DIGITS).reshape(len(lists), len(ids))


def _by_words(queries: DataFrame, index: Inverted, k: int) -> DataFrame:
    """Exact scores of the chunks that can be among the k best."""
    asked = _staged(query_terms(queries, index), "query-terms")

    def met(terms: DataFrame) -> DataFrame:
        return terms.join(index.postings, "term").groupBy("query_id", "chunk_id").agg(F.sum(terms["weight"] * index.postings["weight"]).alias("part"))

    first = top_per_group(met(asked.where(F.col("at") <= FIRST_WORDS)), ["query_id"], [F.desc("part"), "chunk_id"], FIRST_CHUNKS * k)
    reached = top_per_group(_scores(first, asked, index), ["query_id"], [F.desc("score"), "chunk_id"], k)
    enough = reached.where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    bounded = asked.join(enough, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0.0)) - SLACK)
    bounded = _staged(bounded, "bounded-terms")
    needed = bounded.where(F.col("rest") >= LEFT_OUT * F.col("least"))
    # What the words that bring no candidates can add to those of the others.
    beyond = bounded.groupBy("query_id").agg(
        F.max(F.when(F.col("rest") < LEFT_OUT * F.col("least"), F.col("rest"))).alias("beyond"), F.first("least").alias("least")
    )
    open_pairs = met(needed).join(beyond, "query_id").where(F.col("part") + F.coalesce("beyond", F.lit(0.0)) >= F.col("least"))
    return _scores(open_pairs.select("query_id", "chunk_id"), asked, index)
