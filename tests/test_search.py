"""Sparse and approximate retrieval against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from helpers import plan
from trackwork.operators import lsh, sparse
from trackwork.operators.retrieval import top_k_similar


def words(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(chunks, queries, k):
    counts = {c: Counter(words(t)) for c, t in chunks}
    seen = Counter(w for own in counts.values() for w in own)
    idf = defaultdict(lambda: math.log(len(chunks) + 1), {w: math.log((len(chunks) + 1) / (n + 1)) for w, n in seen.items()})

    def unit(own):
        weights = {w: n * idf[w] for w, n in own.items()}
        length = math.sqrt(sum(x * x for x in weights.values()))
        return {w: x / length for w, x in weights.items() if x > 0} if length else {}

    vectors, out = {c: unit(own) for c, own in counts.items()}, set()
    for q, text in queries:
        asked = unit(Counter(words(text)))
        scores = [(-round(sum(x * v[w] for w, x in asked.items() if w in v), 12), c) for c, v in vectors.items() if asked.keys() & v.keys()]
        out |= {(q, c, round(-s, 6), i) for i, (s, c) in enumerate(sorted(scores)[:k], 1)}
    return out


def run(spark, chunks, queries, k):
    index = sparse.build_index(spark.createDataFrame(chunks, "chunk_id string, text string"))
    found = sparse.search(spark.createDataFrame(queries, "query_id long, query_text string"), index, k)
    return {tuple(r) for r in found.collect()}


def test_sparse_search_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    chunks = [(f"c{i:03d}", " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 40)))) for i in range(250)]
    chunks += [("copy1", chunks[5][1]), ("copy2", chunks[5][1].upper() + "!"), ("none", None), ("blank", " -- "), ("one", "w0")]
    queries = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 25)))) for i in range(40)]
    queries += [(100, chunks[5][1]), (101, None), (102, ""), (103, "w0"), (104, "unheard of"), (105, "unheard w0 w250"), (106, "w1 " * 50)]
    for k in (1, 4, 300):
        assert run(spark, chunks, queries, k) == brute(chunks, queries, k)


def test_a_word_of_all_chunks_finds_nothing(spark):
    chunks = [(f"c{i}", f"common rare{i}") for i in range(6)]
    assert run(spark, chunks, [(1, "common")], 4) == set()
    assert run(spark, chunks, [(1, "common rare3")], 4) == {(1, "c3", 1.0, 1)}
    assert run(spark, [], [(1, "common")], 4) == set()


def test_common_words_bring_no_candidates(spark):
    """The words left out of the candidate search are those that stand in most chunks."""
    chunks = [(f"c{i:03d}", f"the of and rare{i} also{i} more{i}") for i in range(60)] + [("z", "other words here")]
    index = sparse.build_index(spark.createDataFrame(chunks, "chunk_id string, text string"))
    asked = sparse.query_terms(spark.createDataFrame([(1, "the of and rare7 also7")], "query_id long, query_text string"), index)
    order = [r.term for r in asked.orderBy("at").collect()]
    assert set(order[:2]) == {"rare7", "also7"} and set(order[2:]) == {"the", "of", "and"}
    rest = {r.term: r.rest for r in asked.collect()}
    assert max(rest[w] for w in ("the", "of", "and")) < 0.05 < rest["rare7"]


def test_few_and_many_queries_find_the_same(spark):
    """Sent to the chunks or looked up by words, with words sent or not, ids that repeat or are null, and copies."""
    rng = random.Random(8)
    chunks = [(f"c{i:03d}", " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(1, 30)))) for i in range(700)]
    queries = [(i, chunks[7 * i][1] + " unheard") for i in range(60)] + [(60, None), (61, "w1"), (61, "w2 w3"), (None, "w1")]
    queries = spark.createDataFrame(queries, "query_id long, query_text string")
    again = [(f"c{i:03d}", chunks[(i * 5) % 700][1]) for i in range(0, 700, 3)] + [(None, "w1 w2"), ("c001", None), ("d", chunks[4][1])]
    for rows in (chunks, chunks + again):
        given = spark.createDataFrame(rows, "chunk_id string, text string")
        index = sparse.build_index(given)
        few = {tuple(r) for r in sparse.search(queries, index, 4).collect()}
        assert len(few) == 61 * 4
        assert few == {tuple(r) for r in sparse.search(queries, index, 4, broadcast_queries=10).collect()}
        for words_sent in (0, 50):
            assert few == {tuple(r) for r in sparse.search(queries, sparse.build_index(given, sent_words=words_sent), 4).collect()}


def test_few_queries_make_no_pairs_to_shuffle(spark):
    """A word of many chunks costs no row per query and chunk: what is shuffled are a task's k best."""
    chunks = spark.createDataFrame([(f"c{i}", f"often word{i}" + " other" * (i % 2)) for i in range(400)], "chunk_id string, text string").repartition(2)
    queries = spark.createDataFrame([(i, f"often word{i}") for i in range(30)], "query_id long, query_text string")
    found = sparse.search(queries, sparse.build_index(chunks), 2)
    shown = plan(found)
    assert "MapInArrow" in shown and "Generate" not in shown and "Join" not in shown
    assert {(r.query_id, r.chunk_id) for r in found.where("rank = 1").collect()} == {(i, f"c{i}") for i in range(30)}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 24))
    rows = [(i, (centres[i % 40] + rng.normal(size=24) * 0.3).tolist()) for i in range(800)]
    rows += [(900, None), (901, [0.0] * 24), (902, rows[3][1]), (903, rows[3][1])]
    return spark.createDataFrame(rows, "chunk_id long, vector array<double>").cache()


def test_all_buckets_give_the_exact_result(spark, vectors):
    asked = vectors.where("chunk_id % 50 = 3").withColumnRenamed("chunk_id", "query_id")
    exact = {tuple(r) for r in top_k_similar(asked, vectors, 5).collect()}
    found = lsh.approximate_top_k(asked, vectors, 5, tables=1, bits=3, probes=8)
    assert {tuple(r) for r in found.collect()} == exact


def test_recall_with_few_buckets(spark, vectors):
    asked = vectors.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    index = lsh.build_lsh(vectors, tables=6, bits=8)
    options = {"tables": 6, "bits": 8, "probes": 4}
    looked = lsh.bucketed(asked.where("vector is not null"), "query_id", 6, 8, 4, lsh.SEED)
    compared = looked.join(index, ["slot", "bucket"]).select("query_id", "chunk_id").distinct().count()
    assert compared < 0.35 * asked.count() * vectors.count()
    row = lsh.recall(top_k_similar(asked, vectors, 4), lsh.approximate_top_k(asked, vectors, 4, index, **options)).first()
    assert row.recall >= 0.9


def test_blocks_of_any_size_find_the_same(spark, vectors):
    """Buckets that share a group, and buckets cut into parts, have the results of comparing all pairs in the buckets."""
    asked = vectors.where("chunk_id % 20 = 3").withColumnRenamed("chunk_id", "query_id")
    index = lsh.build_lsh(vectors, tables=3, bits=4)
    looked = lsh.bucketed(asked.where("vector is not null"), "query_id", 3, 4, 5, lsh.SEED)
    met = {(r.query_id, r.chunk_id) for r in looked.join(index, ["slot", "bucket"]).collect()}
    unit = {r[0]: np.array(r[1]) / (np.linalg.norm(r[1]) or 1) for r in vectors.where("vector is not null").collect()}
    wanted = {}
    for q, c in met:
        wanted.setdefault(q, []).append((-round(float((unit[q] * unit[c]).sum()), 12), c))
    wanted = {(q, c, i) for q, own in wanted.items() for i, (_, c) in enumerate(sorted(own)[:4], 1)}
    options = {"tables": 3, "bits": 4, "probes": 5}
    for blocks in ({}, {"chunk_block": 30, "query_block": 4}):
        found = lsh.approximate_top_k(asked, vectors, 4, index, **options, **blocks)
        assert {(r.query_id, r.chunk_id, r["rank"]) for r in found.collect()} == wanted
    groups = lsh.layout(looked, index, 30, 4)
    hits = lsh.best_in_buckets(asked, vectors, looked, index, groups, 4)
    assert hits.count() < 0.5 * looked.join(index, ["slot", "bucket"]).count()  # no row per pair


def test_probes_are_checked(vectors):
    with pytest.raises(ValueError):
        lsh.approximate_top_k(vectors, vectors, probes=0)
