"""Counts, packing and shards against the tokenizer libraries themselves."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from cases import ROWS, documents, empty
from trackwork.llm.materialise import KEPT_WORDS, materialise, permuted, read_slots, shard_folder
from trackwork.llm.packing import pack, plan_sequences, ranked
from trackwork.llm.token_counts import balanced, count_tokens
from trackwork.llm.tokens import TextTokenizer, tokenizer, vocabulary

WORDS = vocabulary("word_bpe_49k.json")
ODD = [
    "",
    "a  b\t\nc\r\x0bd\x1ce\x85f",
    "<|endoftext|>a <|startoftext|>b < | <|",
    "É é ΣΑΣ σς İI ı ß ẞ ª º µ ½ ² 12½3 auß",
    "don't we'll I'D '''s !!'s",
    "中文 русский",
    "áb ́c",
    "x" * 3000,
    "Ünï×÷çé© </w> a</w>b",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


def expected(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_words_are_encoded_as_the_library_does(library):
    own = tokenizer(WORDS)
    letters = "abAÉßé'1 9\n.,!$|<中"
    rng = random.Random(1)
    for text in ODD + ["".join(rng.choices(letters, k=40)) for _ in range(500)]:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == expected(library, text)
        assert own.counts([text]) == [len(expected(library, text))]


def test_words_of_a_large_vocabulary_are_encoded_once(library):
    texts = [" ".join(f"w{i}" for i in range(start, start + 1000)) for start in range(0, 160_000, 1000)]
    own, small = tokenizer(WORDS, KEPT_WORDS), tokenizer(WORDS, 500)
    met, of = [], own.packed.of
    own.packed.of = lambda word: met.append(word) or of(word)
    once = [own.ids(text) for text in texts]
    assert [own.ids(text) for text in texts] == once and len(met) == 160_000
    assert small.ids(texts[7]) == once[7] and not small.packed
    assert np.frombuffer(once[7], "<u4").tolist() == expected(library, texts[7])


def test_a_batch_looks_up_each_word_once_and_encodes_each_piece_once(library):
    own, met = tokenizer(WORDS, 501), []
    tokenize, looked_up = own.tokenize, []
    own.tokenize = lambda piece: met.append(piece) or tokenize(piece)
    own.packed.__class__ = type("Counted", (type(own.packed),), {"__getitem__": lambda self, word: looked_up.append(word) or dict.__getitem__(self, word)})
    texts = ["Word word, (WORD) word's word...", "word, word, Straße. straße; word", None, "", " \x0c\x0b ", "WORD word"] * 50
    texts += ["".join(random.Random(i).choices("abAÉßé'1 9\n.,!$|<中\x0b", k=40)) for i in range(200)] + ODD + ["a b " * 150_000]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in own.ids_of_each(pa.array(texts))] == [expected(library, text) for text in texts]
    assert len(met) == len(set(met)) and len(looked_up) == len(set(looked_up))
    assert own.ids_of_each(pa.array(["no", "some words", None, "and"]).slice(1, 2)) == [own.ids("some words"), b""]
    assert own.ids_of_each(pa.array([], pa.string())) == [] and own.ids_of_each(pa.array([None], pa.string())) == [b""]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_are_cut_at_safe_places(name):
    own = tokenizer(vocabulary(name))
    assert isinstance(own, TextTokenizer) and own.cuts
    long = "The quick brown fox, don't  jump over it. " * 20_000
    if name.endswith("json"):
        whole = len(Tokenizer.from_file(vocabulary(name)).encode(long, add_special_tokens=False).ids)
    else:
        import sentencepiece

        whole = len(sentencepiece.SentencePieceProcessor(model_file=vocabulary(name)).encode(long))
    assert own.counts([None, long, "a b"])[1] == whole


def test_batches_are_balanced_by_bytes():
    assert list(balanced([5, 5, 30, 1, 1], 10)) == [(0, 2), (2, 3), (3, 5)]
    assert list(balanced([])) == []


def test_counts(spark, library):
    rows = count_tokens(documents(spark), WORDS, 10).collect()
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in rows)
    want = sorted((i or 0, len((t or "").encode()), n := len(expected(library, t)), n > 10) for i, t in ROWS)
    assert got == want
    assert count_tokens(empty(spark), WORDS, 10).count() == 0


def _bins(runs):
    bins, ranks = {}, {}
    for run in runs:
        for rank in range(run.low, run.high):
            ranks.setdefault(run.length, []).append(rank)
            nth, slot = divmod(rank - run.low, run.each)
            bins.setdefault(run.sequence + nth, []).append((run.offset + slot * run.length, run.length))
    return bins, ranks


@pytest.mark.parametrize("seed", range(40))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 30, 64, 4096])
    histogram = {rng.randint(1, capacity): rng.choice([1, 2, 3, 7, 500]) for _ in range(40)}
    bins, ranks = _bins(plan_sequences(histogram, capacity))
    assert {length: sorted(r) for length, r in ranks.items()} == {x: list(range(n)) for x, n in histogram.items()}
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * length > capacity for _, length in pieces) <= 2
    least = -(-sum(x * n for x, n in histogram.items()) // capacity)
    assert len(bins) <= 1.3 * least + 1 or any(2 * x > capacity for x in histogram)


def test_large_pieces_are_paired_as_well_as_can_be():
    assert len(_bins(plan_sequences({6: 2, 5: 2, 4: 3}, 10))[0]) == 4
    assert len(_bins(plan_sequences({5: 3, 4: 1}, 10))[0]) == 2


def test_ranks_of_a_hot_key_are_dealt_over_parts(spark):
    df = spark.range(1000).selectExpr("id", "if(id < 900, 1, id) key")
    rows = ranked(df, "key", ["id"], 7).collect()
    assert sorted(r["rank"] for r in rows if r["key"] == 1) == list(range(900))
    assert all(r["rank"] == 0 for r in rows if r["key"] != 1)


def test_packing_keeps_every_token(spark, library):
    rows = pack(documents(spark), WORDS, 64, 1).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in s) <= 64 for s in by_sequence.values())
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
    for doc, text in dict(ROWS).items():
        if doc in (1, None):
            continue
        ids = np.array(expected(library, text) + [1], dtype="<u4")
        pieces = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [r.start for r in pieces] == list(range(0, len(ids), 64))
        assert [r.ids_crc32 for r in pieces] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces]
    assert len(by_doc[1]) == 2 and len(by_doc[None]) == 2
    assert pack(empty(spark), WORDS, 64, 1).count() == 0


@pytest.mark.parametrize("count", [1, 2, 3, 17, 1000, 4097])
def test_permutation_uses_each_place_once(count):
    places = permuted(np.arange(count), count, 7)
    assert sorted(places.tolist()) == list(range(count))
    if count == 1000:
        assert (places != permuted(np.arange(count), count, 8)).any()
        assert abs(np.corrcoef(np.arange(count), places)[0, 1]) < 0.2


def test_shards_round_trip(spark, library):
    folder = shard_folder(spark)
    manifest = materialise(documents(spark).coalesce(1), WORDS, folder, length=100, key=3, shard_slots=64).collect()
    count = len(manifest)
    assert sorted(r.slot for r in manifest) == list(range(count)) and count > 1000
    read = [x.tolist() for x in read_slots(folder, 0, count, 100, 64)]
    place = permuted(np.arange(count), count, 3)
    stream = [t for n in range(count) for t in read[place[n]]]
    whole = [t for _, text in ROWS for t in [*expected(library, text), 1]]
    assert sorted(stream) == sorted(whole) and stream == whole
    resumed = [x.tolist() for x in read_slots(folder, 70, 30, 100, 64)]
    assert resumed == read[70:100]
    for r in manifest:
        assert r.shard == r.slot // 64 and r.offset == r.slot % 64 * 204
        assert r.ids_crc32 == zlib.crc32(np.array(read[r.slot], "<u2").tobytes()) and r.n_tokens == len(read[r.slot])
    assert materialise(empty(spark), WORDS, shard_folder(spark)).count() == 0
