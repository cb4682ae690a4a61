"""The prefix trie against a brute-force version, with shards and panels small enough to be cut everywhere."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from helpers import plan
from trackwork.llm import prefix_trie as steps
from trackwork.llm.prefix_trie import prefix_trie


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    said = {c: [t[2:] for t in sorted(own)] for c, own in turns.items()}
    whole = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = said.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, own in sorted(whole.items()):
        for d in range(len(own) + 1):
            members[tuple(own[:d])].append(c)
    words = lambda node: len(re.findall("[^\\x20\\x09-\\x0D]+", node[-1][1])) if node else 0
    out = set()
    for node, own in members.items():
        under = [n for n in members if n[: len(node)] == node]
        kids = [n for n in under if len(n) == len(node) + 1]
        leaves = [n for n in under if all(len(whole[c]) == len(n) for c in members[n])]
        saved = sum((len(members[n]) - 1) * words(n) for n in under)
        ends = ",".join(str(c) for c in own if len(whole[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(own), len(node), parent, len(own), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def table(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return df.withColumns({name: F.lit("x") for name in "c d a b h h1 k1 panel block depth words ids n part at".split()})


def conversations(seed, count, longest):
    """Few different turns, so that prefixes are shared; some long copies."""
    random.seed(seed)
    rows = []
    for c in range(count):
        length = random.choice([1, 2, 3, 5, longest])
        same = c % 3 == 0
        for t in range(length):
            pick = t % 2 if same else random.randrange(2)
            rows.append((c, t, ["user", "assistant"][t % 2], ["a b c", " d\u00a0e\n"][pick]))
    return rows


@pytest.mark.parametrize("width,shard,block", [(64, 50_000, 1024), (2, 5, 2), (3, 1, 1)])
def test_against_brute_force(spark, width, shard, block):
    rows = conversations(width, 45, 9)
    rows += [(7, None, None, None), (7, None, None, None), (7, 0, "user", "a b c"), (None, 0, "user", "a"), (-3, 1, None, "x"), (900, 0, "user", "alone")]
    random.shuffle(rows)
    got = [tuple(r) for r in prefix_trie(table(spark, rows), width=width, shard=shard, block=block).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute([r for r in rows])


def test_one_conversation_holds_most_rows(spark):
    rows = [(3, t, "user", f"turn {t % 7}") for t in range(400)] + [(c, t, "user", f"turn {t % 7}") for c in (4, 5, 23) for t in range(390 + c)]
    rows += [(9, 5, "user", "same")] * 300
    got = [tuple(r) for r in prefix_trie(table(spark, rows), width=16, shard=40, block=2).collect()]
    assert set(got) == brute(rows) and len(got) == len(set(got))


def test_very_long_text_and_empty_table(spark):
    long = "word " * 300_000
    rows = [(1, 0, "user", long), (1, 1, "user", long), (2, 0, "user", long), (2, 1, "user", long), (2, 2, "user", "")]
    assert {tuple(r) for r in prefix_trie(table(spark, rows)).collect()} == brute(rows)
    assert prefix_trie(table(spark, [])).collect() == []


def test_panels_are_planned_from_tables(spark):
    """The running sums read stored panels, so that no plan holds all steps several times over."""
    said = spark.createDataFrame([(c, t, "user", f"turn {t}") for c in range(25) for t in range(3)], "conv_id long, turn long, role string, text string")
    turns = steps.rebuilt(steps.numbered(said, "conv_id", "turn", "role", "text"))
    planned = plan(steps.panels(turns, 2, 2))
    assert "FileScan" in planned and "Generate" not in planned
