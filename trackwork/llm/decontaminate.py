"""Benchmark decontamination by greedy string tiling (operator 9).

Documents and benchmark items that share a seed, a few words in a row, are compared: the longest
stretch of words that both have and that is not marked yet is marked, again and again, until what is
left is shorter than a seed. The share of an item that is marked does not depend on the order of its
passages in the document.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwork.llm.shingles import mixed, word_hashes
from trackwork.llm.sketches import summed
from trackwork.llm.tables import in_batches, kind, written
from trackwork.llm.tokens import slices

SEED_WORDS = 5
COVERAGE = 0.5
#: What a letter of a script without blanks counts for, in words; and the share of a document that an item of fewer than ``SEED_WORDS`` has to be.
LETTER, SHORT_SHARE = 0.5, 0.5
#: Bits of the filter that tells which seeds can be in the benchmark; 2 MB for any benchmark.
FILTER_BITS = 24
#: Scripts written without blanks; each letter is a word: Thai to Myanmar, Khmer, kana, Chinese characters.
_SINGLE = "\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
#: Marks that belong to the letter before; a regex has no class for them.
_MARKS = "".join(c for c in map(chr, range(0x300, 0x1FFFF)) if unicodedata.category(c) in ("Mn", "Mc"))
ASCII_WORD = re.compile(rb"[0-9a-z]+")
SINGLE = re.compile(f"(?!\\W)[{_SINGLE}][{_MARKS}]*")
WORD = re.compile(f"\\w[\\w{_MARKS}]*")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Running:
    """Karp-Rabin hashes of all windows of any size over one sequence of word hashes."""

    def __init__(self, hashes: np.ndarray):
        self.size = len(hashes)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_BASE, len(hashes)), dtype=np.uint64)])
        self.back = _powers(_INVERSE, len(hashes) + 1)

    def windows(self, size: int) -> np.ndarray:
        if size > self.size:
            return np.empty(0, dtype=np.uint64)
        count = self.size - size + 1
        return (self.sums[size:] - self.sums[:count]) * self.back[:count]


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words of a text: letters and digits of any script, in lower case; single letters where a script has no blanks."""
    lower = (text or "").lower()
    if lower.isascii():
        return word_hashes(ASCII_WORD.findall(lower.encode()))
    lower = SINGLE.sub(r" \g<0> ", lower.replace("_", " "))
    return word_hashes(" ".join(WORD.findall(lower)).encode("utf-8", "replace").split())


def weights(text: str | None) -> np.ndarray:
    """What each word of ``tokens`` counts for."""
    lower = (text or "").lower()
    if lower.isascii():
        return np.ones(len(ASCII_WORD.findall(lower.encode())))
    found = WORD.findall(SINGLE.sub(r" \g<0> ", lower.replace("_", " ")))
    return np.array([LETTER if SINGLE.fullmatch(w) else 1.0 for w in found])


def covering(item: str | None, doc: str | None) -> tuple[float, list[tuple[int, int, int]]]:
    """Share of an item that tiles of ``SEED_WORDS`` or more cover, and these tiles.

    An item of less than that is covered only where it is found whole, in a document of which it is ``SHORT_SHARE`` or more.
    """
    own, held = tokens(item), tokens(doc)
    worth = weights(item)
    every = worth.sum()
    if every < SEED_WORDS:
        found = tiles(own, held, len(own))[:1]
        return (1.0, found) if found and every >= SHORT_SHARE * weights(doc).sum() else (0.0, [])
    found = [t for t in tiles(own, held, SEED_WORDS) if worth[t[0] : t[0] + t[2]].sum() >= SEED_WORDS]
    return float(sum(worth[i : i + n].sum() for i, _, n in found) / every), found


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows without a marked word."""
    upto = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(upto[size:] == upto[: len(upto) - size]) if size < len(upto) else np.empty(0, np.int64)


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling as (place in item, place in document, words), longest first."""
    a, b = Running(item), Running(doc)
    marked_a, marked_b = np.zeros(len(item), bool), np.zeros(len(doc), bool)

    def common(size):
        at, place = _free(marked_a, size), _free(marked_b, size)
        if not len(at) or not len(place):
            return [], {}
        x, y = a.windows(size)[at], b.windows(size)[place]
        hit = np.isin(y, x)
        places: dict[int, list[int]] = {}
        for h, p in zip(y[hit].tolist(), place[hit].tolist()):
            places.setdefault(h, []).append(p)
        return [(int(i), places[int(h)]) for h, i in zip(x, at) if int(h) in places], places

    out, most = [], len(item)
    while most >= least:
        low, high = least - 1, most  # the longest size with a common window, by bisection
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle)[0] else (low, middle - 1)
        most = low
        if most < least:
            break
        for i, places in common(most)[0]:
            if marked_a[i : i + most].any():
                continue
            for p in places:
                if not marked_b[p : p + most].any():
                    marked_a[i : i + most] = True
                    marked_b[p : p + most] = True
                    out.append((i, p, most))
                    break
    return out


def seeds(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words, told apart from those of other sizes."""
    return mixed(Running(hashes).windows(size) + np.uint64(size))


def benchmark_seeds(benchmark: DataFrame, item_column: str, text: str) -> DataFrame:
    """(item, size, seed) of every item; an item shorter than a seed is one seed of its own size."""

    def cut(batches):
        for batch in batches:
            for part in slices(batch):
                found = [(i, tokens(t)) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                sized = [(i, min(len(h), SEED_WORDS), h) for i, h in found if len(h)]
                made = [(i, size, s) for i, size, h in sized for s in np.unique(seeds(h, size)).view(np.int64).tolist()]
                columns = list(zip(*made)) or [[], [], []]
                kinds = (batch.schema.field(0).type, pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["item", "size", "seed"])

    schema = f"item {kind(benchmark, item_column)}, size int, seed bigint"
    return in_batches(benchmark.select(F.col(item_column), F.col(text).cast("string"))).mapInArrow(cut, schema)


def seed_filter(marks: DataFrame) -> np.ndarray:
    def fill(batches):
        bits = np.zeros(1 << FILTER_BITS, dtype=bool)
        for batch in batches:
            bits[batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - FILTER_BITS)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits, bitorder="little").tobytes()])], names=["bits"])

    filled = summed(marks.select("seed").mapInArrow(fill, "bits binary"), "u1", np.bitwise_or)
    return np.zeros(1 << (FILTER_BITS - 3), np.uint8) if filled is None else filled


def suspects(docs: DataFrame, marks: DataFrame, id_column: str, text: str) -> DataFrame:
    """Documents that may hold a seed: id, text, text_hash, seeds; the others never leave their task."""
    sizes = sorted(row["size"] for row in marks.select("size").distinct().collect())  # at most SEED_WORDS
    shared = docs.sparkSession.sparkContext.broadcast(seed_filter(marks))

    def look(batches):
        bits = shared.value
        for batch in batches:
            for part in slices(batch):
                kept, found = [], []
                for i, value in enumerate(part.column(1).to_pylist()):
                    own = tokens(value)
                    every = np.concatenate([np.empty(0, np.uint64), *(seeds(own, size) for size in sizes)])
                    at = every >> np.uint64(64 - FILTER_BITS)
                    hit = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
                    if hit.any():
                        kept.append(i)
                        found.append(np.unique(every[hit.astype(bool)]).view(np.int64))
                rows = part.take(pa.array(kept, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, pa.list_(pa.int64()))], names=["id", "text", "text_hash", "seeds"])

    rows = docs.select(F.col(id_column), F.col(text).cast("string"), F.xxhash64(F.col(text).cast("string")))
    schema = f"id {kind(docs, id_column)}, text string, text_hash bigint, seeds array<bigint>"
    return in_batches(rows).mapInArrow(look, schema).withColumn("d", F.monotonically_increasing_id())


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    coverage: float = COVERAGE,
    id_column: str = "doc_id",
    text: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Documents that hold at least ``coverage`` of a benchmark item's words, in whatever order.

    Returns a row per document and item: id, item_id, coverage, n_tiles, tiles (places in the item and
    in the document, in words, and lengths), text_hash. Items of equal text are reported under the
    smallest id. A letter of a script without blanks counts for half a word. An item of fewer than five
    words is held by documents of which it is half or more, so that an answer of one word does not
    condemn every text with that word. Null or empty texts hold nothing and are held by nothing; a null item id is kept;
    documents with null ids are compared too; repeated rows are reported each; empty tables give none.
    """
    words = F.col(item_text).cast("string")
    items = benchmark.groupBy(words.alias("words")).agg(F.min(item_column).alias("item"))
    items = written(items.where("words is not null").withColumn("i", F.monotonically_increasing_id()), "items")
    marks = written(benchmark_seeds(items, "i", "words"), "marks")
    held = written(suspects(docs, marks, id_column, text), "suspects")
    pairs = held.select("d", F.explode("seeds").alias("seed")).join(marks.select("seed", F.col("item").alias("i")), "seed")
    pairs = pairs.select("d", "i").distinct()
    both = pairs.join(items, "i").join(held.select("d", "id", "text", "text_hash"), "d")
    both = both.select("id", "item", "text_hash", "words", "text")

    def tile(batches):
        for batch in batches:
            for part in slices(batch, 64):
                kept, columns = [], ([], [], [])
                for i, (own, text) in enumerate(zip(part.column(3).to_pylist(), part.column(4).to_pylist())):
                    covered, found = covering(own, text)
                    if covered >= coverage:
                        kept.append(i)
                        for column, value in zip(columns, (covered, len(found), [dict(zip(("item_at", "doc_at", "words"), t)) for t in found])):
                            column.append(value)
                rows = part.take(pa.array(kept, pa.int64()))
                place = pa.struct([("item_at", pa.int32()), ("doc_at", pa.int32()), ("words", pa.int32())])
                kinds = (pa.float64(), pa.int32(), pa.list_(place))
                made = [rows.column(0), rows.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds)), rows.column(2)]
                yield pa.RecordBatch.from_arrays(made, names=["id", "item_id", "coverage", "n_tiles", "tiles", "text_hash"])

    schema = (
        f"id {kind(docs, id_column)}, item_id {kind(benchmark, item_column)}, coverage double, n_tiles int, "
        "tiles array<struct<item_at: int, doc_at: int, words: int>>, text_hash bigint"
    )
    return in_batches(both).mapInArrow(tile, schema).withColumnRenamed("id", id_column)
