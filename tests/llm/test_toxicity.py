"""The string kernel against a slow version, and the toxicity of held-out and of awkward texts."""

import random
import zlib
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackwork.llm import toxicity as tox

SF_DIR = "/root/testdata/sf0.01"


def slow_features(key):
    """Triples of letters that span at most SPAN characters, weighed by what they span."""
    out = {}
    for i, j, k in combinations(range(len(key)), 3):
        if key[i] and key[j] and key[k] and k - i < tox.SPAN:
            u = (key[i], key[j], key[k])
            out[u] = out.get(u, 0.0) + tox.DECAY ** (k - i + 1)
    return out


def slow_length(key):
    spans = [k - i + 1 for i, j, k in combinations(range(len(key)), 3) if key[i] and key[j] and key[k] and k - i < tox.SPAN]
    return sum(tox.DECAY ** (2 * s) for s in spans) ** 0.5


def slow_kernel(x, y):
    a, b = slow_features(x), slow_features(y)
    length = slow_length(x) * slow_length(y)
    return sum(v * b.get(u, 0.0) for u, v in a.items()) / length if length else 0.0


def keys(seed, count):
    rng = random.Random(seed)
    return [bytes([tox.START, *(rng.choice([0, 1, 2, 3, 4]) for _ in range(rng.randrange(0, 12)))]) for _ in range(count)]


def test_kernel_against_slow_version():
    some = keys(1, 40)
    kernel = tox.Kernel(some)
    tables = kernel.tables(np.arange(len(some)))
    got = np.stack([kernel.against(t) for t in tables], axis=1)
    want = [[slow_kernel(x, y) for y in some] for x in some]
    assert np.allclose(got, want, atol=1e-5)


def test_folded_weights_equal_the_kernel_expansion():
    """Scoring by triples is the same as summing kernels with landmarks."""
    some = keys(2, 60)
    toxic = np.arange(60) < 20
    weights, bias = tox.fit_pieces(some, toxic, np.ones(60), landmarks=40)
    machine = tox.Machine(weights, bias, np.zeros(5))
    others = keys(3, 25)
    own = tox.Kernel(others).against(weights) + bias
    assert np.allclose(machine.pieces(tox._stream(others)), own, atol=1e-4)


def test_pieces_join_single_letters_and_keep_texts_apart():
    found = tox.pieces(["you i d i o t!", "a", "b c", "", "  \t", "x" * 150])
    raw = found.codes.tobytes()
    cut = [raw[a:b] for a, b in zip(found.begins, found.ends)]
    assert found.owner.tolist() == [0, 0, 1, 2, 5, 5, 5]
    assert [c.replace(b"\0", b"") for c in cut[:4]] == [b"?" + bytes([25, 15, 21]), b"?" + bytes([9, 4, 9, 15, 20]), b"?\x01", b"?\x02\x03"]
    assert [len(c) for c in cut[4:]] == [65, 64, 22]
    assert tox.pieces(["", " "]) is None


def test_slices_of_a_long_text_add_up(monkeypatch):
    weights = np.random.default_rng(0).normal(size=[tox.CODES] * 3).astype(np.float32)
    weights[0], weights[:, 0], weights[:, :, 0] = 0, 0, 0  # a gap is no letter
    machine = tox.Machine(weights.ravel(), -0.2, np.zeros(5))
    text = " ".join("".join(random.Random(i).choices("abcdef", k=2 + i % 7)) for i in range(3000))
    whole = tox.measures([text, None, "", text], machine)
    monkeypatch.setattr(tox, "SLICE", 500)
    cut = tox.measures([text, None, "", text], machine)
    assert np.allclose(whole, cut, atol=1e-3) and np.allclose(whole[0], whole[3]) and not whole[1:3].any()


def tables(spark, folder):
    return (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))


def test_held_out_accuracy_and_tolerance(spark):
    """Toxic texts of the held-out fold are found, clean ones left alone; also where insults are spread or padded."""
    docs, labels = tables(spark, "/root/testdata/sf0.1")
    machine = tox.fit(docs, labels)
    truth = labels.join(docs, "doc_id").where("quality = 1").select("doc_id", "toxic", "text", tox.held_out("doc_id").alias("held")).collect()
    held = [r for r in truth if r.held]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    predicted = tox.chance(tox.measures([r.text for r in held], machine), machine) >= tox.THRESHOLD
    toxic = np.array([r.toxic == 1 for r in held])
    assert predicted[toxic].mean() >= 0.95 and predicted[~toxic].mean() <= 0.01
    clean = [r.text for r in truth if r.toxic == 0 and len(r.text) > 300][:40]
    before = tox.chance(tox.measures(clean, machine), machine) >= tox.THRESHOLD
    insults = ["w-o-r-t-h-l-e-s-s", "dissgusting", "pathhetic", "worth_less"]
    spoiled = [" ".join(w if i % 25 else f"{w} {insults[i // 25 % 4]}" for i, w in enumerate(t.split(" "))) for t in clean]
    after = tox.chance(tox.measures(spoiled, machine), machine) >= tox.THRESHOLD
    assert before.mean() <= 0.1 and after.mean() >= 0.8


SCHEMA = "doc_id bigint, text string"


def test_awkward_rows(spark):
    docs, labels = tables(spark, SF_DIR)
    long = "pathetic worthless moron " * 30_000
    rows = [(1, None), (1, ""), (None, "pathetic moron"), (2, long), (3, "\U0001f600 \ud55c\uae00 \u0130"), (4, "x" * 700_000), (2, long)]
    odd = spark.createDataFrame(rows, SCHEMA)
    mixed = docs.select("doc_id", "text").union(odd).withColumns({n: F.lit("x") for n in "id held_out score predicted toxic key _of".split()})
    double = labels.union(labels.limit(5)).union(labels.limit(3).selectExpr("doc_id", "quality", "CAST(null AS int)"))
    double = double.union(labels.limit(1).selectExpr("CAST(null AS bigint)", "quality", "1"))
    out = tox.toxicity(mixed, double.withColumn("text", F.lit("x"))).collect()
    assert len(out) == docs.count() + len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= tox.THRESHOLD) for r in out)
    assert [r.held_out for r in out if r.doc_id is None] == [False]
    assert len({r.score for r in out if r.doc_id == 2 and r.predicted and r.score > 0.5}) >= 1


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], SCHEMA)
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, toxic int")
    for own in (labels, labels.where("false"), labels.withColumn("toxic", F.lit(1))):
        scores = {r.score for r in tox.toxicity(docs, own).collect()}
        assert len(scores) == 1
    assert tox.toxicity(docs.where("false"), labels).collect() == []
