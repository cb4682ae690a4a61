"""Extraction, dialogues, license notices and the quality model."""

import numpy as np
import pytest

from cases import LONG, PLAIN, documents, empty
from trackwork.llm.chat import rotate
from trackwork.llm.html_text import extract, main_text
from trackwork.llm.license_scan import align, hashes, scan_licenses, winnowed
from trackwork.llm import quality
from trackwork.llm.quality import LABELLERS, Lists, Marks, Text, accepted, estimate, fit, signals

SENTENCE = "Here is a sentence, with a comma or two, that is long enough."
PAGES = [
    (f"<article><h1>A</h1><p>{SENTENCE}</p><p>b &amp; c&nbsp;d<br>e</p></article><footer>x</footer>", f"A\n{SENTENCE}\nb & c d e"),
    (f"<div id=main><p>{SENTENCE}<p>Second</div><div class='sidebar'><p>{SENTENCE} {SENTENCE}</p></div>", f"{SENTENCE}\nSecond"),
    (f"<nav><a href=x>{SENTENCE}</a></nav><div><p>{SENTENCE}</p></div><div><p>{SENTENCE}</p></div>", f"{SENTENCE}\n{SENTENCE}"),
    (f"<article><p>{SENTENCE}</p><section id='comments'><p>{SENTENCE}</p></section></article>", SENTENCE),
    (f"<body><header>Site</header><div class='cookie-notice'>{SENTENCE}</div><p>{SENTENCE}</p><form>{SENTENCE}</form>", SENTENCE),
    (f"<p>{SENTENCE}</p><script>var t='</p>';</script><style>p{{}}</style><!-- {SENTENCE} -->", SENTENCE),
    (f"<article><p><b>unclosed {SENTENCE}<br><p>next</p></article>", f"unclosed {SENTENCE}\nnext"),
    (f"<div class='layout has-sidebar'><article><p>{SENTENCE}</p></article><div class='sidebar-content'><p>{SENTENCE}</p></div></div>", SENTENCE),
    ("<ul><li>one<li>two</ul>", "one\ntwo"),
    ("no markup", "no markup"),
    ("", ""),
    (None, ""),
    ("<p>a < b && c</p>", "a < b && c"),
    ("<div>" * 3000 + SENTENCE, SENTENCE),
]


@pytest.mark.parametrize("html, text", PAGES)
def test_main_text(html, text):
    assert main_text(html) == text


MORE = SENTENCE.replace("Here", "There")
NAMED = [
    (f"<article><h2 id='related-work'>Related work</h2><p>{SENTENCE}</p></article>", f"Related work\n{SENTENCE}"),
    (f"<article><p>{SENTENCE}</p><section id='search'><p>{MORE}</p></section></article>", f"{SENTENCE}\n{MORE}"),
    (f"<article id='copyright-law'><p>{SENTENCE}</p></article>", SENTENCE),
    ("<article><p>One <span class='search-hit'>word</span> of a sentence, found.</p></article>", "One word of a sentence, found."),
    (f"<article><p>{SENTENCE}</p><p class='form'>{MORE}</p></article>", f"{SENTENCE}\n{MORE}"),
    (f"<div class='page-content with-sidebar'><h2>A</h2><p>{SENTENCE}</p><p>{MORE}</p></div><div><p>Short.</p></div>", f"A\n{SENTENCE}\n{MORE}"),
    (f"<div class='notice'>{f'<p>{SENTENCE}</p>' * 30}</div><div><a href=x>{MORE}</a></div>", "\n".join([SENTENCE] * 30)),
    (f"<article><p>{SENTENCE} <math><mi>x</mi><annotation>\\x</annotation></math></p></article>", f"{SENTENCE} x"),
    (f"<main><h1>Title</h1><p>{MORE}</p><article><p>{SENTENCE}</p></article></main>", f"Title\n{MORE}\n{SENTENCE}"),
    (f"<main><article><p>{SENTENCE}</p><p>{SENTENCE}</p></article><div class='related'><p>{MORE}</p></div></main><div><p>{MORE}</p></div>", f"{SENTENCE}\n{SENTENCE}"),
]


@pytest.mark.parametrize("html, text", NAMED)
def test_names_do_not_drop_text_of_the_article(html, text):
    assert main_text(html) == text


def test_extract(spark):
    rows = [(i, f"u{i}", h) for i, (h, _) in enumerate(PAGES)] + [(None, None, "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in extract(df).collect()}
    assert got == {i: (f"u{i}", t, len(t)) for i, (_, t) in enumerate(PAGES)} | {None: (None, "x", 1)}
    assert extract(df.where("false")).count() == 0


def test_every_speaker_is_assistant_once(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "bob", "yo"), (1, 2, "user", None), (1, 2, "user", None), (2, None, None, "x"), (None, 5, "a", "é" * 3)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS at", "2 AS m", "3 AS part")
    got = {(r.conv_id, r.perspective, r.part): r for r in rotate(df).collect()}
    assert set(got) == {(1, "user", 0), (1, "bob", 0), (2, "unknown", 0), (None, "a", 0)}
    bob = got[1, "bob", 0]
    assert bob.text == "<|user name=user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n" + "<|user name=user|>\n<|end|>\n" * 2
    for r in got.values():
        spans = [tuple(map(int, s.split("-"))) for s in r.targets.split(";") if s]
        assert all(r.text[: a].endswith("<|assistant|>\n") and r.text[a:b].endswith("<|end|>\n") for a, b in spans)
        assert r.n_target_chars == sum(b - a for a, b in spans) and len(spans) == r.text.count("<|assistant|>")
    assert got[1, "user", 0].n_turns == 4
    assert rotate(df.where("false")).count() == 0


def test_a_long_dialogue_is_cut_into_parts(spark):
    rows = [(7, t // 3, "ab"[t % 2], f"{t:03d}") for t in range(300)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    parts = sorted((r for r in rotate(df, part_turns=16).collect() if r.perspective == "a"), key=lambda r: r.part)
    assert [r.n_turns for r in parts] == [16] * 18 + [12]
    said = [line for r in parts for line in r.text.split("\n") if line[:3].isdigit()]
    assert [int(x[:3]) // 3 for x in said] == [t // 3 for t in range(300)] and len(set(said)) == 300


NOTICE = "Licensed under the Apache License, Version 2.0."


def test_license_notices(spark):
    changed = "This work is LICENSED under the terms of GNU General Public License version 3"
    rows = [(1, f"{PLAIN}\n{NOTICE}\n{PLAIN}"), (2, NOTICE + " " + NOTICE), (3, changed), (4, "licensed to kill"), (5, None), (6, LONG + " " + NOTICE), (None, NOTICE), (7, "")]
    found = scan_licenses(documents(spark, rows)).collect()
    got = sorted((r.doc_id or 0, r.license, r["last"] - r["first"]) for r in found)
    size = len(NOTICE) - 1  # to the end of the last word
    assert got == [(0, "Apache-2.0", size), (1, "Apache-2.0", size), (2, "Apache-2.0", size), (2, "Apache-2.0", size), (3, "GPL-3.0", len(changed)), (6, "Apache-2.0", size)]
    assert next(r for r in found if r.doc_id == 1)["first"] == len(PLAIN) + 1
    assert scan_licenses(empty(spark)).count() == 0


def test_whole_texts_and_headers_of_usual_licenses():
    from trackwork.llm.license_scan import BAND, COVERAGE, TEMPLATES, index, scan
    from trackwork.llm.license_texts import WHOLE

    known = index(TEMPLATES)

    def names(text):
        return [known.names[m.template] for m in scan(text, known, BAND, COVERAGE)]

    for name, text in WHOLE:
        assert names(f"{PLAIN}\n{text}\n{PLAIN}") == [name]
    for name, text in TEMPLATES:
        assert names(f"{PLAIN} {text} {PLAIN}") == [name]
    for i in range(50):  # a template of three words is found whatever is beside it
        assert names(f"left{i} l{i} All rights reserved. r{i} right{i}") == ["all-rights-reserved"]
    assert names(PLAIN * 20) == []


def test_fingerprints_meet_in_any_four_equal_words():
    rng = np.random.default_rng(1)
    for _ in range(200):
        shared = rng.integers(0, 50, 4).astype(np.uint64)
        a, b = (np.concatenate([rng.integers(100, 999, n).astype(np.uint64), shared, rng.integers(100, 999, n).astype(np.uint64)]) for n in (3, 5))
        assert set(winnowed(a)[1].tolist()) & set(winnowed(b)[1].tolist())


def test_alignment_in_a_band_equals_the_whole_table():
    rng = np.random.default_rng(4)
    for _ in range(100):
        a, b = rng.integers(0, 5, 12).astype(np.uint64), rng.integers(0, 5, 20).astype(np.uint64)
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = max(table[i, j + 1], table[i + 1, j], table[i, j] + (a[i] == b[j]))
        assert align(a, b, 0, 40)[0] == table[-1, -1]
    assert align(hashes(["x"]), hashes(["y", "x"]), 0, 8) == (1, 1, 2)


def test_accuracies_are_found_without_labels():
    rng = np.random.default_rng(0)
    bad = rng.random(20_000) < 0.2
    rates = [(0.9, 0.002), (0.7, 0.001), (0.6, 0.004)]
    fires = np.stack([np.where(bad, rng.random(len(bad)) < p, rng.random(len(bad)) < q) for p, q in rates], axis=1)
    values, counts = np.unique(fires @ (1 << np.arange(3)), return_counts=True)
    on_bad, on_good, share = estimate(dict(zip(values.tolist(), counts.tolist())), 3)
    assert np.allclose(on_bad, [p for p, _ in rates], atol=0.08) and np.allclose(on_good, [q for _, q in rates], atol=0.03)
    assert abs(share - 0.2) < 0.02


def test_quality_on_held_out_labels(spark):
    """Lists are learned from half of the labels; the other half is judged."""
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in accepted(docs, labels.where("doc_id % 2 = 0")).select("doc_id").collect()}
    judged = [r for r in labels.where("doc_id % 2 = 1").collect()]
    clean = [r.doc_id in kept for r in judged if r.quality and not r.toxic]
    toxic = [r.doc_id in kept for r in judged if r.toxic]
    junk = [r.doc_id in kept for r in judged if not r.quality]
    assert sum(clean) / len(clean) > 0.99
    assert sum(toxic) / len(toxic) < 0.1
    assert sum(junk) / len(junk) < 0.1


def test_abuse_is_told_by_the_share_of_learned_words():
    abuse = sum(1 << LABELLERS.index(name) for name in quality.DEFECTS["abuse"])
    marks = Marks(Lists(frozenset(["zorb"]), frozenset(["blim"])))
    assert signals(Text("you are a zorb and a blimmer too"), marks) & abuse == abuse
    assert signals(Text(PLAIN * 200 + " zorb blimmer"), marks) & abuse == 0
    assert signals(Text("you idiot, you stupid clown, you trash"), Marks(Lists(frozenset(), frozenset()))) & abuse == 0


def test_hot_ids_are_fitted_on_like_all_others(spark):
    rows = [(None, f"null {i}") for i in range(1000)] + [(7, f"hot {i}") for i in range(1000)] + [(8, "copy")] * 500 + [(i, f"text {i}") for i in range(100, 1600)]
    for hot in (7, 12, 31):  # whichever id is hot
        docs = documents(spark, [(hot if i == 7 else i, t) for i, t in rows])
        chosen = quality.fitted_rows(docs, len(rows), 400, "doc_id", "text").collect()
        assert all(r.id is not None for r in chosen)
        assert 40 < sum(r.id == hot for r in chosen) < 160
        assert len(chosen) == len({(r.id, r.text) for r in chosen}) < 400
    assert len(quality.fitted_rows(docs, len(rows), len(rows), "doc_id", "text").collect()) == 2501


def test_quality_of_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id bigint, toxic int")
    kept = accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 12
    assert accepted(empty(spark), labels).count() == 0
    assert fit(docs, labels.where("false")).lists.words == frozenset()
    assert len(LABELLERS) == 14
