"""Hard negatives against brute force: every pair scored with integers of any size."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackwork.llm.hard_negatives import Bucket, mine

SCHEMA = "vec_id bigint, embedding array<double>, label int"


def usable(row):
    _, v, label = row
    return row[0] is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, every=100, k=5, n=10):
    rows = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in filter(usable, rows)]
    out = []
    for anchor in rows:
        if anchor[0] % every:
            continue
        others = [(sum(a * b for a, b in zip(anchor[1], v)), i, label) for i, v, label in rows if i != anchor[0] and len(v) == len(anchor[1])]
        others.sort(key=lambda r: (-r[0], r[1]))
        for score, positive, _ in [r for r in others if r[2] == anchor[2]][:k]:
            fits = [r for r in others if r[2] != anchor[2] and 30 * score <= 100 * r[0] <= 90 * score][:n]
            out += [(anchor[0], positive, rank, i, score, s) for rank, (s, i, _) in enumerate(fits, 1)]
    return sorted(out)


def table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({name: F.lit("x") for name in "row id v dim length asks part seq extra owner slot rank score windows".split()})


def vectors(seed, count, dim=6, labels=3, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim))
    return [
        (i, (centres[c := int(rng.integers(labels))] + spread * rng.normal(size=dim)).round(2).tolist(), int((c + (rng.random() < 0.3)) % labels))
        for i in range(count)
    ]


@pytest.mark.parametrize("seed,bucket,seeds", [(1, 7, 0), (2, 40, 20), (3, 4096, 2048)])
def test_against_brute_force(spark, seed, bucket, seeds):
    rows = vectors(seed, 260, spread=0.2 * seed) + [
        (None, [1.0] * 6, 1), (1000, None, 1), (1100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1200, [math.nan] * 6, 1), (1300, [math.inf] * 6, 1),
        (1400, [1.0] * 6, None), (1500, [0.0] * 6, 1), (1600, [1.0, 2.0], 1), (1601, [1.5, 2.0], 1), (1602, [0.5, 0.7], 2), (1700, [], 1), (1701, [], 2),
        (1702, [], 1),
    ]
    random.Random(seed).shuffle(rows)
    got = sorted(tuple(r) for r in mine(table(spark, rows), F.col("vec_id") % 20 == 0, bucket=bucket, seeds=seeds).select(*"anchor_id positive_id rank negative_id positive_score negative_score".split()).collect())
    assert got == brute(rows, every=20)


def test_ties_copies_and_repeated_ids(spark):
    rows = [(i, [0.5, 0.25, -0.125], i % 2) for i in range(150)] + [(i, [0.3, 0.1, 0.0], i % 3) for i in range(150, 320)]
    rows += [(100, [0.5, 0.25, -0.125], 0), (111, [0.3, 0.1, 0.0], 1), (111, [0.3, 0.1, 0.0], 1)]
    got = sorted(tuple(r) for r in mine(table(spark, rows), F.col("vec_id") % 100 == 0, bucket=16).collect())
    assert got == brute(rows)


def test_long_products_are_exact(spark):
    rng = random.Random(5)
    rows = [(i, [float(rng.randrange(-(2**21), 2**21)) for _ in range(4)], i % 2) for i in range(120)]
    rows += [(200, [1e300] * 4, 0), (201, [float(2**23)] * 4, 0)]
    got = sorted(tuple(r) for r in mine(table(spark, rows), F.col("vec_id") % 40 == 0, bucket=30).collect())
    assert got == brute([r for r in rows if r[0] < 200], every=40)


def test_empty_table(spark):
    assert mine(table(spark, []), F.col("vec_id") % 100 == 0).collect() == []


def test_pruning_skips_candidates():
    """A high threshold leaves few candidates, and all that reach it."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(40, 8))[rng.integers(40, size=3000)] + rng.normal(size=(3000, 8)) * 0.05
    v = (v / np.linalg.norm(v, axis=1, keepdims=True) * 1000).astype(np.int64)
    bucket = Bucket(8, np.stack([np.arange(3000)] * 2).astype(np.int64).tobytes(), np.zeros(3000, np.int64).tobytes(), v.astype(np.int64).tobytes())
    scores = bucket.products(v[:50])
    limits = np.sort(scores, axis=1)[:, -3]
    tested = 0
    for q, rows in bucket.near(v[:50], limits):
        rows = np.arange(3000) if rows is None else rows
        tested += len(rows)
        assert set(np.flatnonzero(scores[q] >= limits[q])) <= set(rows)
    assert tested < 0.3 * 50 * 3000
