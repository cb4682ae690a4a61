"""Toxicity by a string-kernel support vector machine (operator 11).

Texts are cut into pieces: words, or runs of single letters, so that ``i d i o t`` is one. The kernel of
two pieces counts the triples of letters that both have in order, each weighed down by the letters and
signs it spans; inserted characters and gaps cost weight, not the match. Landmark pieces span a Nyström
feature space, a linear machine with squared hinge loss is fitted there to pieces of labelled texts, and
its weights are carried back to triples. So scoring a piece is one sum over its triples, equal to the
kernel expansion over all landmarks, and costs a text one pass whatever their number.

A text is judged by its pieces on the toxic side: how many, which share of all, how far.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Collection, Iterable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwork.llm.tables import in_batches, kind, written
from trackwork.llm.tokens import slices

#: Letters of a matched sequence are 3; characters one may span, and the weight for each.
SPAN, DECAY = 6, 0.7
#: Codes of letters (a-z, others by their number), of anything between them, and of the start of a piece.
CODES, GAP, START = 64, 0, 63
#: A longer run without white space is cut.
PIECE = 64
#: Characters of a text that are scored at a time.
SLICE = 1 << 19
#: Bounds of what is fitted: labelled texts (by hash of id and text), toxic pieces, common, other and hard clean pieces, landmarks.
TRAINED, TOXIC_PIECES, COMMON_PIECES, OTHER_PIECES, HARD_PIECES, LANDMARKS = 20_000, 2_000, 4_000, 8_000, 4_000, 160
#: How sure it must be that a piece stands in toxic texts more often than by chance (twice a log-likelihood ratio), and how often it does.
SURE, MOSTLY = 17.0, 0.8
RIDGE, TOXIC_SHARE = 1e-3, 0.3
#: How far within the clean side's margin a piece is hard.
MARGIN = 0.5
THRESHOLD = 0.3
HELD_OUT, FOLDS = 2, 4
FEATURES = 4


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Code of every character, and whether it is white space."""
    every = [chr(i) for i in range(0x110000)]
    letter = np.fromiter((c.isalpha() for c in every), dtype=bool, count=len(every))
    space = np.fromiter((c.isspace() for c in every), dtype=bool, count=len(every))
    number = np.arange(len(every), dtype=np.int64)
    plain = (number >= ord("a")) & (number <= ord("z"))
    code = np.where(plain, number - ord("a") + 1, 27 + number % (START - 27))
    return np.where(letter, code, GAP).astype(np.uint8), space


class Pieces(NamedTuple):
    """A stream of codes; piece ``i`` begins at ``begins[i]``, ``piece`` is the number at each place, ``owner`` its text."""

    codes: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    piece: np.ndarray
    owner: np.ndarray


def pieces(texts: list[str]) -> Pieces | None:
    """Pieces of lower-cased texts; None where there are none."""
    code, space = _tables()
    lengths = np.array([len(t) + 1 for t in texts])
    stream = "".join("\n" + t for t in texts) + "\n" * SPAN
    points = np.frombuffer(stream.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    blank = space[points]
    starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    if not len(starts):
        return None
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    codes = code[points]
    before = np.concatenate([[0], np.cumsum(codes > 0)])
    owner = np.searchsorted(np.cumsum(lengths), starts, side="right")
    single = before[ends] - before[starts] <= 1
    joined = np.zeros(len(starts), dtype=bool)
    joined[1:] = single[1:] & single[:-1] & (owner[1:] == owner[:-1])
    first = np.flatnonzero(~joined)
    starts, ends, owner = starts[first], ends[np.append(first[1:], len(ends)) - 1], owner[first]
    codes[starts - 1] = START
    count = np.maximum(1, -(-(ends - starts) // PIECE))
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begins = np.repeat(starts, count) + place * PIECE - (place == 0)
    ends = np.minimum(np.repeat(starts, count) + (place + 1) * PIECE, np.repeat(ends, count))
    marks = np.zeros(len(codes), dtype=np.int32)
    marks[begins] = 1
    return Pieces(codes, begins, ends, np.cumsum(marks, dtype=np.int32), np.repeat(owner, count))


def triples(codes: np.ndarray, piece: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each shape: characters spanned, whether it lies in one piece at each place, and its number there."""
    wide = codes.astype(np.int32)
    size = len(codes) - SPAN + 1
    for last in range(2, SPAN):
        inside = piece[:size] == piece[last : last + size]
        ends = (wide[:size] << 12) + wide[last : last + size]
        for middle in range(1, last):
            yield last + 1, inside, ends + (wide[middle : middle + size] << 6)


def norms(codes: np.ndarray, piece: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Length of each piece in the space of triples, as if none occurred twice in it."""
    size = len(codes) - SPAN + 1
    letter = (codes > 0).astype(np.float32)
    upto = np.cumsum(letter, dtype=np.float64)
    total = np.zeros(len(codes))
    for last in range(2, SPAN):
        ends = (piece[:size] == piece[last : last + size]) * letter[:size] * letter[last : last + size]
        total[:size] += DECAY ** (2 * (last + 1)) * ends * (upto[last - 1 : last - 1 + size] - upto[:size])
    return np.sqrt(np.add.reduceat(total, begins))


class Machine(NamedTuple):
    """Weights of triples with bias; weights, means and scales of what a text is judged by."""

    triples: np.ndarray
    bias: float
    text: np.ndarray

    def pieces(self, found: Pieces) -> np.ndarray:
        """Signed distance of each piece, above 0 on the toxic side."""
        size = len(found.codes) - SPAN + 1
        total = np.zeros(len(found.codes), dtype=np.float32)
        for span, inside, number in triples(found.codes, found.piece):
            total[:size] += np.float32(DECAY**span) * inside * self.triples[number]
        length = norms(found.codes, found.piece, found.begins)
        sums = np.add.reduceat(total, found.begins)
        return np.where(length > 0, sums / np.where(length > 0, length, 1), 0.0) + self.bias


def _parts(text: str) -> Iterable[str]:
    """A text in slices, cut behind white space where there is any."""
    start = 0
    while len(text) - start > SLICE:
        cut = max(text.rfind(" ", start, start + SLICE), text.rfind("\n", start, start + SLICE)) + 1
        cut = cut if cut > start else start + SLICE
        yield text[start:cut]
        start = cut
    yield text[start:] if start else text


def _sliced(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Slices of lower-cased texts in loads of about ``SLICE`` characters, with their texts' places."""
    owners, load, size = [], [], 0
    for i, text in enumerate(texts):
        for part in _parts((text or "").lower()):
            owners.append(i)
            load.append(part)
            size += len(part)
            if size >= SLICE:
                yield owners, load
                owners, load, size = [], [], 0
    if load:
        yield owners, load


def measures(texts: list[str | None], machine: Machine) -> np.ndarray:
    """Per text: pieces on the toxic side, all pieces, their distances' sum, and the greatest one."""
    out = np.zeros((len(texts), FEATURES))
    for owners, load in _sliced(texts):
        found = pieces(load)
        if found is None:
            continue
        value = machine.pieces(found)
        at = np.asarray(owners)[found.owner]
        np.add.at(out[:, 0], at, value > 0)
        np.add.at(out[:, 1], at, 1)
        np.add.at(out[:, 2], at, np.maximum(value, 0))
        np.maximum.at(out[:, 3], at, np.maximum(value, 0))
    return out


def judged(measured: np.ndarray) -> np.ndarray:
    """What the judgement of a text is linear in: number, share and strength of toxic pieces, none of which grows without bound."""
    hits, count, total, most = measured.T
    share = hits / np.maximum(count, 1)
    return np.stack([np.ones(len(hits)), np.log1p(hits), np.log1p(1000 * share), np.log1p(1000 * total / np.maximum(count, 1)), most], axis=1)


def chance(measured: np.ndarray, machine: Machine) -> np.ndarray:
    return np.round(1 / (1 + np.exp(-np.clip(judged(measured) @ machine.text, -30, 30))), 6)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression, by Newton's method; the first column is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge * len(x) / 100)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        bend = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, steps: int = 50) -> np.ndarray:
    """Linear support vector machine with squared hinge loss, by Newton's method; the last column is the constant."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-9
    for _ in range(steps):
        miss = 1 - y * (x @ w)
        active = miss > 0
        a, wa = x[active], weight[active]
        slope = penalty * w - a.T @ (wa * y[active] * miss[active])
        step = np.linalg.solve((a * wa[:, None]).T @ a + np.diag(penalty), slope)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def _stream(keys: list[bytes]) -> Pieces:
    """Pieces that are given by their codes."""
    lengths = np.array([len(k) for k in keys])
    codes = np.frombuffer(b"".join(keys) + bytes(SPAN), dtype=np.uint8)
    begins = np.cumsum(lengths) - lengths
    piece = np.append(np.repeat(np.arange(len(keys), dtype=np.int32), lengths), np.full(SPAN, len(keys), dtype=np.int32))
    return Pieces(codes, begins, begins + lengths, piece, np.arange(len(keys)))


class Kernel:
    """Triples of many pieces, ready to be compared with landmarks."""

    def __init__(self, keys: list[bytes]):
        found = _stream(keys)
        length = norms(found.codes, found.piece, found.begins)
        scale = np.divide(1.0, length, out=np.zeros_like(length), where=length > 0)
        rows, numbers, weights = [], [], []
        letter = found.codes > 0
        size = len(found.codes) - SPAN + 1
        for span, inside, number in triples(found.codes, found.piece):
            middle = (number >> 6) & 63
            at = np.flatnonzero(inside & letter[:size] & (middle > 0) & ((number & 63) > 0))
            rows.append(found.piece[at])
            numbers.append(number[at])
            weights.append(DECAY**span * scale[found.piece[at]])
        self.rows, self.numbers, self.weights = (np.concatenate(x) for x in (rows, numbers, weights))
        self.count = len(keys)

    def tables(self, some: np.ndarray) -> np.ndarray:
        """The pieces in ``some`` as rows of weights of triples."""
        where = np.full(self.count, -1)
        where[some] = np.arange(len(some))
        own = where[self.rows]
        out = np.zeros((len(some), CODES**3), dtype=np.float32)
        np.add.at(out, (own[own >= 0], self.numbers[own >= 0]), self.weights[own >= 0])
        return out

    def against(self, table: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights=self.weights * table[self.numbers], minlength=self.count)


def fit_pieces(keys: list[bytes], toxic: np.ndarray, weight: np.ndarray, hard: Collection[bytes] = (), landmarks: int = LANDMARKS) -> tuple[np.ndarray, float]:
    """(weights of triples, bias) of the machine that parts toxic pieces from the others; landmarks are of each kind."""
    kernel = Kernel(keys)
    chosen = []
    difficult = np.array([k in hard for k in keys])
    for side in (toxic, ~toxic & ~difficult, ~toxic & difficult):
        own = np.flatnonzero(side)
        chosen.append(own[np.argsort(-weight[own], kind="stable")][: landmarks // 2])
    tables = kernel.tables(np.concatenate(chosen))
    near = np.stack([kernel.against(t) for t in tables], axis=1)
    values, vectors = np.linalg.eigh(near[np.concatenate(chosen)])
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    x = np.column_stack([near @ root, np.ones(len(keys))])
    balance = np.where(toxic, TOXIC_SHARE * weight / weight[toxic].sum(), (1 - TOXIC_SHARE) * weight / weight[~toxic].sum())
    w = hinge(x, np.where(toxic, 1.0, -1.0), balance)
    return (root @ w[:-1]).astype(np.float32) @ tables, float(w[-1])


def _sure(toxic: np.ndarray, clean: np.ndarray, all_toxic: int, all_clean: int) -> np.ndarray:
    """Twice the log-likelihood ratio of a piece's share of toxic contexts against the share of all."""
    base = all_toxic / (all_toxic + all_clean)
    n = toxic + clean
    part = lambda k, p: np.where(k > 0, k * np.log(np.maximum(k, 1) / np.maximum(n * p, 1e-9)), 0.0)
    return np.where(toxic / n > base, 2 * (part(toxic, base) + part(clean, 1 - base)), 0.0)


def sample_of(docs: DataFrame, labels: DataFrame, id_column: str, text: str, label: str, bound: int) -> DataFrame:
    """(text, toxic) of about ``bound`` labelled rows at most, none of the fold that is held out; equal rows once.

    Labels are thinned by their id, then rows by id and text, so that a repeated id is no exception.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column))
    known = known.groupBy(F.col(id_column).cast("string").alias("_of")).agg((F.max(label) > 0).cast("int").alias("toxic"))
    share = lambda n: F.lit(int(min(1.0, bound / max(n, 1)) * 2**32))
    hashed = lambda *c: F.pmod(F.xxhash64(*c), F.lit(2**32))
    chosen = known.where(hashed("_of") < share(known.count()))  # about ``bound`` ids: small enough to send
    rows = docs.select(F.col(id_column).cast("string").alias("_of"), F.col(text).cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), "_of").where("text is not null")
    kept = rows.where(hashed("_of", "text") < share(rows.count())).dropDuplicates(["_of", "text"])
    return written(kept.select("text", "toxic"), "labelled")


def held_out(id_column: str):
    return F.coalesce(F.crc32(F.col(id_column).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def piece_counts(sample: DataFrame) -> DataFrame:
    """(key, toxic, clean): in how many different contexts (neighbours) a piece stands in texts of either label."""

    def emit(batches):
        for batch in batches:
            for part in slices(batch):
                texts, toxic = part.column(0).to_pylist(), part.column(1).to_pylist()
                seen = [Counter(), Counter()]
                for owners, load in _sliced(texts):
                    found = pieces(load)
                    if found is None:
                        continue
                    raw = found.codes.tobytes()
                    keys = [raw[a:b] for a, b in zip(found.begins.tolist(), found.ends.tolist())]
                    around = [hash_of(a, b) for a, b in zip([b"", *keys], [*keys[1:], b""])]
                    for key, context, owner in zip(keys, around, found.owner.tolist()):
                        seen[toxic[owners[owner]]][key, context] += 1
                rows = [(k, c, side) for side in (0, 1) for k, c in seen[side]]
                columns = list(zip(*rows)) or [[]] * 3
                kinds = (pa.binary(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["key", "context", "toxic"])

    from zlib import crc32

    def hash_of(before: bytes, after: bytes) -> int:
        return crc32(after, crc32(before))

    found = in_batches(sample.select("text", "toxic")).mapInArrow(emit, "key binary, context bigint, toxic int").distinct()
    return found.groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))


def _trained(likely, clean: dict[bytes, int], hard: list[bytes]) -> Machine:
    keys = [bytes(k) for k in likely["key"]] + list(clean)
    toxic = np.arange(len(keys)) < len(likely)
    seen = np.concatenate([likely["toxic"].to_numpy(dtype=np.float64), np.fromiter(clean.values(), dtype=np.float64, count=len(clean))])
    return Machine(*fit_pieces(keys, toxic, np.log1p(seen), set(hard)), np.zeros(0))


def _nearest_misses(counts: DataFrame, shared, listed: set[bytes]) -> list[tuple[bytes, int]]:
    """The clean pieces that lie farthest on the toxic side or next to it."""

    @F.pandas_udf("double")
    def value(keys):
        import pandas as pd

        return pd.Series(shared.value.pieces(_stream([bytes(k) for k in keys]))) if len(keys) else pd.Series([], dtype=float)

    mostly_clean = F.col("toxic") < MOSTLY * (F.col("toxic") + F.col("clean"))
    near = counts.where((F.col("clean") > 0) & mostly_clean).withColumn("value", value("key")).where(F.col("value") > -1 + MARGIN)
    rows = near.orderBy(F.desc("value"), "key").limit(HARD_PIECES).collect()
    return [(bytes(r["key"]), r["clean"]) for r in rows if bytes(r["key"]) not in listed]


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", trained: int = TRAINED) -> Machine:
    """The machine learned from labelled texts, of which about ``trained`` are used; without toxic ones it finds none."""
    sample = sample_of(docs, labels, id_column, text, label, trained)
    rows = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    base = rows.get(1, 0) / max(1, sum(rows.values()))
    nothing = Machine(np.zeros(CODES**3, dtype=np.float32), -1.0, np.array([np.log(max(base, 1e-6) / max(1 - base, 1e-6)), 0, 0, 0, 0]))
    if len(rows) < 2:
        return nothing
    counts = written(piece_counts(sample), "piece-counts")
    totals = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    often = counts.where("toxic >= 3").orderBy(F.desc(F.col("toxic") / (F.col("toxic") + F.col("clean"))), F.desc("toxic"), "key").limit(4 * TOXIC_PIECES)
    likely = often.toPandas()
    counted = [likely[c].to_numpy(dtype=np.float64) for c in ("toxic", "clean")]
    good = (_sure(*counted, *totals) >= SURE) & (counted[0] >= MOSTLY * (counted[0] + counted[1])) if len(likely) else np.zeros(0, bool)
    likely = likely[good].head(TOXIC_PIECES)
    if likely.empty:
        return nothing
    by_hash = [F.xxhash64("key"), F.col("key")]
    common = counts.where("clean > 0").orderBy(F.desc("clean"), "key").limit(COMMON_PIECES).toPandas()
    other = counts.where("clean > 0").orderBy(*by_hash).limit(OTHER_PIECES).toPandas()
    clean = {bytes(k): n for frame in (other, common) for k, n in zip(frame["key"], frame["clean"])}
    for key in likely["key"]:
        clean.pop(bytes(key), None)
    context = docs.sparkSession.sparkContext
    machine = _trained(likely, clean, [])._replace(text=nothing.text)
    # Again, with the clean pieces that the first machine takes for toxic or nearly so.
    hard = _nearest_misses(counts, context.broadcast(machine), set(map(bytes, likely["key"])))
    machine = _trained(likely, clean | dict(hard), [k for k, _ in hard])._replace(text=nothing.text)
    shared = context.broadcast(machine)

    def measure(batches):
        for batch in batches:
            for part in slices(batch):
                own = measures(part.column(0).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in own.T), part.column(1)], names=[*"abcd", "toxic"])

    seen = in_batches(sample).mapInArrow(measure, "a double, b double, c double, d double, toxic int").toPandas()  # a row per text of the sample
    seen = seen.sort_values(list(seen.columns)).to_numpy()
    return machine._replace(text=logistic(judged(seen[:, :FEATURES]), seen[:, FEATURES]))


def toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", trained: int = TRAINED) -> DataFrame:
    """Every document's toxicity: id, held_out, score (0 to 1), predicted (1 from ``THRESHOLD``).

    Labels of rows with ``crc32(id) % 4 == 2`` are not learned from; ``held_out`` marks these rows. Whole texts
    are scored, by nothing but their characters. A null text is empty; a null id is not held out and not learned
    from; repeated rows are scored each. Several labels of an id count as toxic if one of them is; null labels
    are ignored. Without toxic or without clean labels every document has the score of their share. Empty
    tables give no rows; other columns are not read. Texts of more than half a million characters are cut
    behind white space and added up; runs of more than 64 characters without any are several pieces.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_column, text, label, trained))

    def score(batches):
        for batch in batches:
            for part in slices(batch):
                found = chance(measures(part.column(2).to_pylist(), shared.value), shared.value)
                predicted = pa.array((found >= THRESHOLD).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found), predicted], names=["id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_column).alias("id"), held_out(id_column).alias("held_out"), F.col(text).cast("string").alias("text"))
    schema = f"id {kind(docs, id_column)}, held_out boolean, score double, predicted int"
    return in_batches(rows).mapInArrow(score, schema).withColumnRenamed("id", id_column)
