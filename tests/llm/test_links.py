"""Similarity joins, components, tiling and neighbours against brute force."""

import random
import re
import time
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest

from cases import LONG, PLAIN, documents, empty
from trackwork.llm import jaccard
from trackwork.llm.components import components
from trackwork.llm.decontaminate import SEED_WORDS, contaminated, tiles, tokens, weights
from trackwork.llm.jaccard import Similarity, jaccard_components
from trackwork.llm.nearest import nearest
from trackwork.llm.shingles import shingle_set
from trackwork.llm.sketches import without
from trackwork.llm.tables import CLEANUP_SETTING, written


def roots(vertices, edges):
    parent = {v: v for v in vertices}

    def top(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    return {v: top(v) for v in vertices}


@pytest.mark.parametrize("shape", ["path", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(3)
    edges = {
        "path": [(i, i + 1) for i in range(60)],
        "star": [(0, i) for i in range(1, 80)],
        "random": [(rng.randrange(100), rng.randrange(100)) for _ in range(60)],
    }[shape]
    found = {r.v: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = roots({v for e in edges for v in e if e[0] != e[1]}, edges)
    pairs = [(a, b) for a, b in combinations(sorted(found), 2)]
    assert set(found) == {v for e in edges if e[0] != e[1] for v in e}
    assert all((found[a] == found[b]) == (want[a] == want[b]) for a, b in pairs)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def near_copies(seed, groups, size, changes):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(groups):
        base = rng.choices(words, k=rng.randint(30, 120))
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randint(0, changes)):
                own[rng.randrange(len(own))] = rng.choice(words) + "x" * rng.randint(0, 2)
            rows.append(" ".join(own[: rng.choice([len(own), len(own), -3])]))
    return list(enumerate(rows))


@pytest.mark.parametrize("words, share", [(4, 85), (5, 80), (2, 60)])
def test_components_of_similar_texts(spark, words, share):
    shared = " shared line of many common words that stands in every text here"
    rows = [(i, t + shared) for i, t in near_copies(words, 6, 25, 5)] + [(900, "one two"), (901, "One TWO"), (902, ""), (903, None), (904, "two one")]
    sets = {i: set(shingle_set((t or "").encode(), words).tolist()) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b])]
    want = roots(sets, links)
    found = jaccard_components(documents(spark, rows), Similarity(words, share)).collect()
    assert {r.doc_id: r.component_id for r in found} == want
    assert {r.doc_id: r.n_shingles for r in found} == {i: len(s) for i, s in sets.items()}


def test_two_groups_that_meet_only_in_buckets_of_two(spark):
    """Members of the centre's group beside its first class are compared with the other group."""
    like, rows = Similarity(1, 85), []
    for family in range(16):
        base = [f"f{family}w{i}" for i in range(52)]
        often, other = ([f"{name}{i}" for i in range(4)] for name in ("often", "other"))
        alone = [f"f{family}x{i}" for i in range(4)]
        # The first two differ in words of many texts only: equal prefixes. The third is like the second only.
        rows += [(10 * family + i, " ".join(own)) for i, own in enumerate((base + often, base + other, base + other + alone))]
    sets = {i: set(t.split()) for i, t in rows}
    edges = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = roots(sets, edges)
    assert len(edges) == 32 and len(set(want.values())) == 16
    found = jaccard_components(documents(spark, rows), like).collect()
    assert {r.doc_id: r.component_id for r in found} == want
    members, _, _ = jaccard.classes_in_groups(written(jaccard.prefixes(documents(spark, rows), "doc_id", "text", like), "p"))
    assert members.where("v <> g").count() > 8


def test_a_large_group_of_near_copies_takes_few_comparisons(spark):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(500):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(150)] = f"n{rng.randrange(10**9)}"
        rows.append((i, " ".join(own)))
    like, docs = Similarity(4, 85), documents(spark, rows)
    members, heads, counts = jaccard.classes_in_groups(written(jaccard.prefixes(docs, "doc_id", "text", like), "p"))
    shared = jaccard.buckets(heads, like)
    tested = written(jaccard.first_pairs(members, shared).distinct(), "t")
    rooted = written(jaccard.with_roots(members, jaccard.links(jaccard.may_link(tested, counts, like), members, docs, "doc_id", "text", like)), "r")
    rest = jaccard.open_pairs(rooted, shared, like)
    assert tested.count() + rest.count() < 5 * len(rows)


def test_places_are_shuffled_once_and_prefixes_are_not_grouped(spark, monkeypatch):
    plans, like = {}, Similarity(4, 85)

    def noted(df, name, *more):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, name, *more)

    monkeypatch.setattr(jaccard, "written", noted)
    docs = documents(spark, near_copies(3, 6, 10, 5))
    _, heads, _ = jaccard.classes_in_groups(written(jaccard.prefixes(docs, "doc_id", "text", like), "p"))
    shared = jaccard.buckets(heads, like)
    assert "prefix#" not in plans["classes"] and "counts#" not in plans["classes"]
    assert not re.search(r"hashpartitioning\(s#\d+L, \d+\), ENSURE_REQUIREMENTS", plans["buckets"])
    own = {(r.g, s): (r.n, at, r.several) for r in heads.collect() for at, s in enumerate(r.prefix)}
    kept = shared.collect()
    assert kept and all(own[r.g, r.s][:2] == (r.n, r.at) for r in kept)
    groups = {}
    for (g, s), (_, _, several) in own.items():
        groups.setdefault(s, []).append(several)
    assert all(r.open == (len(groups[r.s]) > 2 or any(groups[r.s])) for r in kept)


def test_shuffle_files_go_with_the_write(spark):
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for folder in folders for f in Path(folder).rglob("shuffle_*.data")}
    before, setting = files(), spark.conf.get(CLEANUP_SETTING, None)
    kept = written(spark.range(5000).repartition(3, "id"), "t")
    end = time.time() + 20
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before and kept.count() == 5000
    assert spark.conf.get(CLEANUP_SETTING, None) == setting


def test_awkward_rows_of_the_similarity_join(spark):
    rows = jaccard_components(documents(spark)).collect()
    assert len(rows) == 12
    found = {r.doc_id: r.component_id for r in rows if r.doc_id}
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8}
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert jaccard_components(empty(spark)).count() == 0


def test_without_keeps_rows_and_columns(spark):
    docs = documents(spark)
    gone = docs.where("doc_id = 2 or (doc_id is null and text is not null)").selectExpr("doc_id", "xxhash64(text)")
    once = docs.where("doc_id = 1").selectExpr("doc_id", "xxhash64(text)")
    left = without(docs, "doc_id", "text", gone, once)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 3, 4, 5, 6, 7, 8, 9]


ITEM = " ".join(f"i{n}" for n in range(30))
MOVED = " ".join([*ITEM.split()[20:], "x y z", *ITEM.split()[10:20], "q", *ITEM.split()[:10]])


def brute_tiles(item, doc, least):
    """Covered words by trying all matches, longest first."""
    a, b = [False] * len(item), [False] * len(doc)
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return sum(a)
        a[i : i + n] = [True] * n
        b[j : j + n] = [True] * n


def test_tiling_against_brute_force():
    rng = random.Random(5)
    for _ in range(150):
        item = [rng.randrange(6) for _ in range(rng.randint(1, 25))]
        doc = [rng.randrange(6) for _ in range(rng.randint(0, 40))]
        got = tiles(np.array(item, dtype=np.uint64), np.array(doc, dtype=np.uint64), 3)
        assert sum(n for *_, n in got) == brute_tiles(item, doc, 3)
        assert all(item[i : i + n] == doc[j : j + n] for i, j, n in got)


def test_contamination(spark):
    benchmark = spark.createDataFrame([(1, ITEM), (2, ITEM), (3, "short one"), (4, None), (5, "")], "item_id bigint, text string")
    rows = [(1, f"{PLAIN} {ITEM.upper()}, {PLAIN}"), (2, MOVED), (3, " ".join(ITEM.split()[:8])), (4, PLAIN), (5, "A short, one!"), (6, None), (None, ITEM), (7, LONG + " " + ITEM), (8, ITEM), (8, ITEM)]
    found = contaminated(documents(spark, rows), benchmark.withColumnRenamed("text", "text")).collect()
    got = sorted((r.doc_id or 0, r.item_id, round(r.coverage, 3)) for r in found)
    assert got == [(0, 1, 1.0), (1, 1, 1.0), (2, 1, 1.0), (5, 3, 1.0), (7, 1, 1.0), (8, 1, 1.0), (8, 1, 1.0)]
    assert next(r for r in found if r.doc_id == 2).n_tiles == 3
    assert contaminated(empty(spark), benchmark).count() == 0
    assert contaminated(documents(spark, rows), benchmark.where("false")).count() == 0


def test_short_items_and_single_letters_do_not_condemn_long_texts(spark):
    benchmark = spark.createDataFrame([(1, "Paris"), (2, "中国的首都是哪里呢"), (3, "今天天气很好我们去公园散步然后回家吃饭"), (4, "one two three four")], "item_id bigint, text string")
    rows = [
        (1, "We went to Paris in the spring and stayed for a week."), (2, "Paris."), (3, "他说中国的首都很大很好"), (4, "中国的首都是哪里呢？"),
        (5, "前文在此，今天天气很好我们去公园散步然后回家吃饭。后文继续！"), (6, "今天天气很好他说"), (7, "one two three four"), (8, "it was one two three four five six seven eight"),
    ]
    found = {(r.doc_id, r.item_id) for r in contaminated(documents(spark, rows), benchmark).collect()}
    assert found == {(2, 1), (4, 2), (5, 3), (7, 4)}


def test_words_of_any_script():
    passage = "今天天气很好我们去公园散步然后回家吃饭"
    assert len(tokens(passage)) == len(passage)
    within, alone = tokens(f"前文在此，“{passage}”。后文继续！").tolist(), tokens(passage).tolist()
    assert any(within[i : i + len(alone)] == alone for i in range(len(within)))
    assert tokens("«été» — “straße”, l’eau…").tolist() == tokens("été straße l eau").tolist()
    assert len(tokens("สวัสดีครับ")) > 4 and len(tokens("हिन्दी में")) == 2 and len(tokens("ひらがなカタ")) == 6
    for text in (passage, "«été» — “straße”, l’eau…", "สวัสดีครับ हिन्दी में", "a_b c-d", None):
        assert len(weights(text)) == len(tokens(text))
    assert weights(passage).sum() == len(passage) / 2
    assert tokens("a_b c-d 12").tolist() == tokens("a b c d 12").tolist()


def test_seeds_are_shorter_than_any_match_that_counts():
    assert len(tokens(ITEM)) > SEED_WORDS


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    vectors = {i: rng.normal(size=8).astype(np.float32).tolist() for i in range(300)}
    for i in range(100, 140):
        vectors[i] = vectors[100]  # equal vectors tie
    vectors |= {300: [0.0] * 8, 301: None, 302: [float("nan")] * 8, 303: [1.0] * 7 + [None], 304: [float("inf")] + [1.0] * 7, 305: [1.0, 2.0], 306: [2.0, 1.0]}
    rows = [*vectors.items(), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS c", "2 AS v", "3 AS score")
    got: dict = {}
    from pyspark.sql import functions as F

    for r in nearest(df, F.col("vec_id") % 5 == 0, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    usable = {i: np.array(v, dtype=np.float64) for i, v in vectors.items() if i < 300 or i > 304}
    for q in (i for i in usable if i % 5 == 0):
        own = usable[q]
        scores = [(-(own @ v) / np.sqrt((own @ own) * (v @ v)), i) for i, v in usable.items() if i != q and len(v) == len(own)]
        want = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in scores)[:4]]
        assert [i for i, _ in got[q]] == [i for i, _ in want]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want], atol=1e-9)
    assert set(got) == {i for i in usable if i % 5 == 0}
    assert nearest(df.where("false"), F.col("vec_id") % 5 == 0, 4).count() == 0


def test_neighbours_send_every_query_once(spark, monkeypatch):
    """Blocks of queries are broadcast as they are, not a copy for every block of candidates."""
    from pyspark.sql import functions as F

    from helpers import plan
    from trackwork.llm import nearest as module

    df = spark.range(200).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(6)), lambda x: F.sin(x * (F.col("id") + 1))).alias("embedding"))
    whole = sorted(map(tuple, nearest(df, F.col("vec_id") % 5 == 0, 3).collect()))
    plans = []
    written = module.written
    monkeypatch.setattr(module, "written", lambda df, name: plans.append((name, plan(df))) or written(df, name))
    monkeypatch.setattr(module, "BLOCK", 16)
    for numbers, rounds in ((1 << 22, 1), (100, 3)):
        monkeypatch.setattr(module, "SENT_NUMBERS", numbers, raising=False)
        plans.clear()
        assert sorted(map(tuple, nearest(df, F.col("vec_id") % 5 == 0, 3).collect())) == whole
        near = [text for name, text in plans if name == "near"]
        assert len(near) == rounds and all("Generate explode" not in text for text in near)


@pytest.mark.parametrize("kind", ["doubled", "copies", "many vectors of one id"])
def test_neighbours_of_repeated_ids(spark, kind):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(40)]
    if kind == "doubled":
        rows *= 2
    elif kind == "copies":
        rows = rows * 6 + [(100, rows[0][1]), (101, rows[5][1])]
    else:
        rows += [(0, (np.array(rows[0][1]) + rng.normal(size=4) / 50).tolist()) for _ in range(30)] + [(5, rows[0][1])] * 9
        rows = [(i, np.float32(v).tolist()) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got: dict = {}
    for r in nearest(df, F.col("vec_id") % 5 == 0, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    for q in {i for i, _ in rows if i % 5 == 0}:
        vectors = [np.array(v) for v in {tuple(v) for i, v in rows if i == q}]
        scores = [(-round(float(own @ np.array(v) / np.sqrt((own @ own) * (np.array(v) @ np.array(v)))), 9), i) for own in vectors for i, v in rows if i != q]
        assert got[q] == [(i, -s) for s, i in sorted(scores)[:5]]
