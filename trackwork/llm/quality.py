"""Quality classifier from weak labels (operator 5).

Heuristic labellers fire on signs of junk or of abuse; for each defect there are several that overlap.
Expectation-maximisation over the counts of their joint firings estimates how often each fires on
documents with and without the defect, without true labels; the posteriors become training labels of
a linear scorer over hashed features.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Collection, Iterator
from itertools import chain, islice
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwork.llm.sketches import summed
from trackwork.llm.tables import in_batches, written
from trackwork.llm.tokens import slices

#: Bounds of what the models are fitted on; documents are chosen by a hash of id and text.
LABELLED = 30_000
TRAINED = 20_000
#: A listed word needs so many different neighbours in abusive documents, and may have so many clean
#: documents for each; of all words, so many may be listed by chance. A stem begins so many different words.
SUPPORT, IMPURITY, BY_CHANCE = 3, 0.02, 0.5
STEM_WORDS, STEM_SIZES = 3, (4, 5, 6, 7)
#: Weight of all words of a text together, beside a labeller's 1.
WORDS_WEIGHT = 0.3
FEATURE_BITS = 18
#: Passes over a part of the fitted documents, more where they are few; documents of a part; step size.
EPOCHS, STEPS, PART, RATE = 8, 20_000, 2_500, 0.5
#: Features that a task holds; with more, or ``PART`` documents, it fits and begins again.
HELD = 1 << 21
THRESHOLD = 0.5
#: How often a labeller is expected to fire on good documents, and the share of all that this counts as seen.
RARELY, PRIOR = 0.001, 1.0

#: Shares of a text's words, copies counted, from which listed ones are a sign of abuse, and a strong one.
SOME, MANY = 0.005, 0.01
#: Labellers by defect, in the order of their bits.
DEFECTS = {
    "shouting": ("capital_letters", "capital_words", "exclamations"),
    "symbols": ("symbol_share", "symbol_runs", "few_letters"),
    "tables": ("bar_words", "bar_lines"),
    "repetition": ("equal_neighbours", "few_distinct_words", "equal_lines"),
    "abuse": ("listed_words", "many_listed_words", "listed_stems"),
}
LABELLERS = [name for names in DEFECTS.values() for name in names]

#: ASCII letters in lower case, blanks for all other ASCII, the rest as it is.
_LETTERS = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_WIDE = bytes(range(128, 256))
_RUNS = (b"##", b"$$", b"%%", b"&&", b"**", b"@@", b"~~")
_SYMBOLS = b"!\"#$%&()*+/:;<=>?@[\\]^`{|}~"


class Lists(NamedTuple):
    """Terms that mark abuse in labelled documents."""

    words: frozenset[str]
    stems: frozenset[str]


class Text:
    """A text's bytes, its blank-separated parts, and its different words."""

    def __init__(self, text: str | None):
        self.raw = (text or "").encode("utf-8", "replace")
        self.parts = self.raw.split()
        self.every = words(self.raw)
        self.words = set(self.every)


def words(raw: bytes) -> list[bytes]:
    """Runs of letters, A-Z in lower case; whatever is not ASCII counts as a letter."""
    return raw.translate(_LETTERS).split()


class Marks:
    """Looks for the learned lists of abuse in a text's words."""

    def __init__(self, lists: Lists):
        self.listed = frozenset(w.encode() for w in lists.words)
        self.stems = frozenset(s.encode() for s in lists.stems)
        self.heads = frozenset(s[:4] for s in self.stems)
        self.sizes = sorted({len(s) for s in self.stems})

    def __call__(self, text: Text) -> tuple[bool, bool, bool]:
        listed = self._share(text, self.listed & text.words)
        stems: set[bytes] = set()
        if self.stems and not self.heads.isdisjoint({w[:4] for w in text.words}):
            stems = {w for w in text.words if w[:4] in self.heads and any(w[:n] in self.stems for n in self.sizes)}
        return listed >= SOME, listed >= MANY, self._share(text, stems) >= SOME

    @staticmethod
    def _share(text: Text, found: Collection[bytes]) -> float:
        return sum(w in found for w in text.every) / len(text.every) if found else 0.0


def signals(text: Text, marks: Marks) -> int:
    """Bits of the labellers that fire, in the order of ``LABELLERS``."""
    raw, parts, size, n = text.raw, text.parts, len(text.raw), len(text.parts)
    lines = [line for line in raw.split(b"\n") if line]
    upper, lower = size - len(raw.translate(None, _UPPER)), size - len(raw.translate(None, _LOWER))
    symbols, wide = size - len(raw.translate(None, _SYMBOLS)), size - len(raw.translate(None, _WIDE))
    different = len(set(parts))
    # The cheap conditions that come first in a line only spare work: the others imply them.
    fires = (
        upper > 20 and upper > lower,
        n >= 5 and upper > 0.5 * n and sum(map(bytes.isupper, parts)) > 0.5 * n,
        n >= 5 and raw.count(b"!!") > 0.3 * n,
        size >= 100 and symbols > 0.1 * size,
        n >= 5 and symbols > 0.6 * n and sum(map(raw.count, _RUNS)) > 0.3 * n,
        n >= 10 and upper + lower + wide + n < 0.75 * size,
        n >= 10 and parts.count(b"|") > 0.05 * n,
        n >= 10 and b"|" in raw and sum(line.count(b" | ") >= 2 for line in lines) > 0.3 * len(lines),
        n >= 10 and different < 0.75 * n + 1 and sum(map(eq, parts, islice(parts, 1, None))) > 0.3 * n,
        n >= 30 and different < 0.35 * n,
        len(lines) >= 4 and len(set(lines)) <= 0.5 * len(lines),
        *marks(text),
    )
    return sum(1 << i for i, fire in enumerate(fires) if fire)


def sampled(ids: Column, rows: int, bound: int) -> Column:
    """True for about ``bound`` of ``rows`` ids, by hash; for all of them if there are no more."""
    # A null has a hash of its own: callers leave it out.
    return F.pmod(F.xxhash64(ids), F.lit(max(rows, 1))) < bound


def learn_lists(docs: DataFrame, labels: DataFrame, id_column: str, text: str, label: str, bound: int) -> Lists:
    """Words, and beginnings of words, that labelled abusive documents have and clean ones hardly ever.

    What counts for a word is how many different pairs of neighbours it has in abusive documents: copies of
    one document, with or without changes, do not make all their words abusive.
    """
    known = labels.select(F.col(id_column).alias("_id"), F.col(label).alias("bad")).where("_id is not null and bad is not null")
    n = known.count()
    known = known.where(sampled(F.col("_id"), n, bound))
    rows = docs.where(sampled(F.col(id_column), n, bound)).select(F.col(id_column).alias("_id"), F.col(text).cast("string").alias("text"))
    rows = rows.join(known, "_id").where("text is not null").select("text", (F.col("bad") > 0).cast("int").alias("bad"))

    def split(batches):
        for batch in batches:
            for part in slices(batch):
                found = []
                for text, bad in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = [w.decode() for w in words(text.encode("utf-8", "replace"))]
                    if not bad:
                        found += [(w, 0, 0) for w in set(own)]
                        continue
                    first = {w: i for i, w in reversed(list(enumerate(own)))}
                    around = ["", *own, ""]
                    found += [(w, hash_pair(around[i], around[i + 2]), 1) for w, i in first.items()]
                columns = list(zip(*found)) or [[], [], []]
                kinds = (pa.string(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["word", "around", "bad"])

    met = in_batches(rows).mapInArrow(split, "word string, around bigint, bad int").groupBy("word", "around", "bad").agg(F.count(F.lit(1)).alias("n"))
    counted = met.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum(F.expr("if(bad = 0, n, 0)")).alias("good"))
    counted = written(counted, "words")
    share = min(max(rows.agg(F.avg("bad")).first()[0] or 0.5, 0.01), 0.9)

    def telling(frame):
        """Rows that would hardly have only abusive documents by chance."""
        least = max(SUPPORT, int(np.ceil(np.log(BY_CHANCE / max(frame.count(), 1)) / np.log(share))))
        return frame.where((F.col("bad") >= least) & (F.col("good") <= IMPURITY * F.col("bad")))

    sizes = F.array(*(F.lit(k) for k in STEM_SIZES))
    stems = counted.withColumn("size", F.explode(sizes)).where("length(word) > size")
    stems = stems.groupBy(F.expr("substring(word, 1, size)").alias("stem"))
    stems = stems.agg(F.count(F.lit(1)).alias("words"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    stems = telling(stems.where(F.col("words") >= STEM_WORDS))

    def listed(frame, name):  # at most the words of the labelled rows
        return frozenset(r[0] for r in frame.select(name).collect())

    return Lists(listed(telling(counted), "word"), listed(stems, "stem"))


def hash_pair(left: str, right: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{left} {right}") >> 1


def estimate(counts: dict[int, int], labellers: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Chance that each labeller fires on bad and on good documents, and the share of bad ones.

    Starts from "bad if any fires". Pseudo-counts keep every chance off 0 and 1; they say that labellers rarely
    fire on good documents, which settles what firings of one labeller alone cannot.
    """
    if not counts:
        return np.full(labellers, 0.5), np.full(labellers, 0.01), 0.01
    patterns = np.array(sorted(counts))
    weight = np.array([counts[p] for p in patterns.tolist()], dtype=float)
    fires = (patterns[:, None] >> np.arange(labellers)) & 1
    bad, prior = np.where(fires.any(axis=1), 0.9, 0.01), PRIOR * weight.sum() + 1
    for _ in range(rounds):
        on_bad = ((weight * bad) @ fires + 1) / ((weight * bad).sum() + 2)
        on_good = ((weight * (1 - bad)) @ fires + RARELY * prior) / ((weight * (1 - bad)).sum() + prior)
        share = ((weight * bad).sum() + 0.01) / (weight.sum() + 1)
        new = _posterior(fires, on_bad, on_good, share)
        if np.abs(new - bad).max() < 1e-9:
            break
        bad = new
    return on_bad, on_good, share


def _posterior(fires: np.ndarray, on_bad: np.ndarray, on_good: np.ndarray, share: float) -> np.ndarray:
    odds = np.log(share / (1 - share)) + fires @ np.log(on_bad / on_good) + (1 - fires) @ np.log((1 - on_bad) / (1 - on_good))
    return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


class WeakLabels(NamedTuple):
    """Estimates for the labellers of each defect."""

    defects: tuple

    def bad(self, patterns: np.ndarray) -> np.ndarray:
        """Chance that documents with these firings have any defect."""
        clean, first = np.ones(len(patterns)), 0
        for on_bad, on_good, share in self.defects:
            clean *= 1 - _posterior((patterns[:, None] >> (first + np.arange(len(on_bad)))) & 1, on_bad, on_good, share)
            first += len(on_bad)
        return 1 - clean


def features(pattern: int, found: Collection[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed places and values: each labeller with weight 1, all words together with a fixed length."""
    own = [b"\0", *(b"\0%d" % i for i in range(len(LABELLERS)) if pattern >> i & 1)]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, chain(own, found)), dtype=np.uint64, count=len(own) + len(found))
    values = np.ones(len(hashes))
    values[len(own) :] = WORDS_WEIGHT * max(len(found), 1) ** -0.5
    return (hashes >> np.uint64(64 - FEATURE_BITS)).astype(np.int64), values


class Model(NamedTuple):
    """Everything that scoring a text takes; its size does not depend on the data."""

    lists: Lists
    weak: WeakLabels
    weights: np.ndarray


class Scorer:
    """A model that reads texts."""

    def __init__(self, model: Model):
        self.weights, self.marks = model.weights, Marks(model.lists)

    def __call__(self, text: str | None) -> float:
        """Chance that a text should be rejected."""
        read = Text(text)
        at, values = features(signals(read, self.marks), read.words)
        # Words come out of a set in any order; summed exactly, they give the same score in every process.
        return 1 / (1 + math.exp(-min(max(math.fsum((self.weights[at] * values).tolist()), -40), 40)))


def fitted_rows(docs: DataFrame, rows: int, bound: int, id_column: str, text: str) -> DataFrame:
    """About ``bound`` of ``rows`` rows at most, as (id, text): no null ids, equal rows once, rows of one id thinned like all others."""
    own = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text")).where("id is not null")
    return own.where(sampled(F.struct("id", "text"), rows, bound)).dropDuplicates(["id", "text"])


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", labelled: int = LABELLED, trained: int = TRAINED) -> Model:
    """Word lists from at most about ``labelled`` labelled rows, label model from all documents, weights from ``trained`` of them."""
    lists = learn_lists(docs, labels, id_column, text, label, labelled)
    shared_lists = docs.sparkSession.sparkContext.broadcast(lists)

    @F.pandas_udf("int")
    def fired(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        marks = Marks(shared_lists.value)
        for texts in batches:
            yield texts.map(lambda t: signals(Text(t), marks), na_action=None).astype("int32")

    value = F.col(text).cast("string")
    patterns = in_batches(docs).select(fired(value).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2^14 rows
    counts = {r["p"]: r["n"] for r in patterns}
    rows = sum(counts.values())
    parts, first = [], 0
    for names in DEFECTS.values():
        own: Counter = Counter()
        for p, n in counts.items():
            own[(p >> first) & ((1 << len(names)) - 1)] += n
        parts.append(estimate(own, len(names)))
        first += len(names)
    weak = WeakLabels(tuple(parts))
    shared = docs.sparkSession.sparkContext.broadcast((lists, weak))

    def train(batches):
        lists, weak = shared.value
        marks = Marks(lists)
        examples, held = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                read = Text(text)
                pattern = signals(read, marks)
                examples.append((*features(pattern, sorted(read.words)), float(weak.bad(np.array([pattern]))[0])))
                held += len(examples[-1][0])
                if held >= HELD or len(examples) >= 2 * PART:
                    yield fitted(examples)
                    examples, held = [], 0
        if examples:
            yield fitted(examples)

    def fitted(examples):
        weights, seen = np.zeros(1 << FEATURE_BITS), np.full(1 << FEATURE_BITS, 1e-6)
        for _ in range(max(EPOCHS, -(-STEPS // max(len(examples), 1)))):
            for at, values, wanted in examples:
                got = 1 / (1 + np.exp(-np.clip(weights[at] @ values, -40, 40)))
                step = (got - wanted) * values
                seen[at] += step * step
                weights[at] -= RATE * step / np.sqrt(seen[at])
        made = np.concatenate([weights * len(examples), [len(examples)]])
        return pa.RecordBatch.from_arrays([pa.array([made.tobytes()], pa.binary())], names=["weights"])

    chosen = fitted_rows(docs, rows, trained, id_column, text)
    parts = -(-min(max(rows, 1), trained) // PART)
    chosen = chosen.repartition(parts, F.xxhash64("id", "text")).sortWithinPartitions("id", "text").select("text")
    total = summed(in_batches(chosen).mapInArrow(train, "weights binary"), "f8")
    weights = np.zeros(1 << FEATURE_BITS) if total is None or not total[-1] else total[:-1] / total[-1]
    return Model(lists, weak, weights.astype(np.float32))


def reject_score(model: Model, text: Column) -> Column:
    """The chance, to 6 digits, that a text should be rejected."""

    shared = SparkSession.active().sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield texts.map(scorer, na_action=None).astype("float64").round(6)

    return score(text.cast("string"))


def scored(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, reject_score) of every row, by a model fitted on these documents."""
    model = fit(docs, labels, id_column, text)
    return docs.select(id_column, reject_score(model, F.col(text)).alias("reject_score"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that a model fitted on these documents keeps, with all their columns.

    No labeller fires on a null or empty text: it is kept. Null ids are kept by their text; they and null
    labels are not fitted on. Repeated rows get the same score. An empty table gives none; without labels only
    the signs of junk count. Other columns are not read.
    """
    return docs.where(reject_score(fit(docs, labels, id_column, text), F.col(text)) < threshold)
