"""Packing documents into sequences of fixed capacity (operator 7).

Only the number of pieces of each length matters for a packing, and there are no more lengths than
the capacity. The driver packs that histogram; tasks then look up the place of each piece by its
rank among the pieces of its length. What the driver holds does not grow with the data.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackwork.llm.tables import in_batches, kind, written
from trackwork.llm.tokens import CACHED_WORDS, slices, tokenizer

#: Pieces that one task ranks; lengths with more are dealt over several tasks by hash.
RANKED_TOGETHER = 100_000
RANK_BITS = 44


class Run(NamedTuple):
    """Where pieces of one length and the ranks ``low <= rank < high`` go: ``each`` to a sequence."""

    length: int
    low: int
    high: int
    sequence: int
    offset: int
    each: int


class _Gaps:
    """Ranges of equal sequences by the room they have left."""

    def __init__(self):
        self.sizes: list[int] = []
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def add(self, gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in self.ranges:
                insort(self.sizes, gap)
                self.ranges[gap] = []
            self.ranges[gap].append((first, count))

    def take(self, length: int) -> tuple[int, int, int] | None:
        """A range with the smallest room that holds ``length``: (gap, first, count)."""
        at = bisect_left(self.sizes, length)
        if at == len(self.sizes):
            return None
        gap = self.sizes[at]
        first, count = self.ranges[gap].pop()
        if not self.ranges[gap]:
            del self.ranges[gap]
            self.sizes.pop(at)
        return gap, first, count


def plan_sequences(histogram: dict[int, int], capacity: int) -> list[Run]:
    """Place all pieces of a length histogram.

    Of pieces above a third of the capacity no three share a sequence: the longest goes with the
    longest that still fits beside it. Shorter pieces follow, longest first, each into the
    sequence with the least room that holds it; a new sequence is opened if there is none.
    """
    left = {length: n for length, n in histogram.items() if n}
    used = dict.fromkeys(left, 0)
    runs, gaps, sequences = [], _Gaps(), 0

    def place(length: int, n: int, first: int, offset: int, each: int = 1) -> None:
        runs.append(Run(length, used[length], used[length] + n, first, offset, each))
        used[length] += n
        left[length] -= n

    large = sorted(length for length in left if 3 * length > capacity)
    while large:
        longest = large[-1]
        at = bisect_right(large, capacity - longest) - 1
        partner = large[at] if at >= 0 else None
        if partner == longest:
            pairs = left[longest] // 2
        else:
            pairs = min(left[longest], left[partner]) if partner else 0
        if pairs:
            place(longest, pairs, sequences, 0)
            place(partner, pairs, sequences, longest)
            gaps.add(capacity - longest - partner, sequences, pairs)
            sequences += pairs
        if not pairs or (partner == longest and left[longest]):
            alone = left[longest] if partner != longest else 1
            if partner == longest and at > 0:  # one is over: it goes with the next shorter length
                place(longest, 1, sequences, 0)
                place(large[at - 1], 1, sequences, longest)
                gaps.add(capacity - longest - large[at - 1], sequences, 1)
                sequences += 1
            else:
                place(longest, alone, sequences, 0)
                gaps.add(capacity - longest, sequences, alone)
                sequences += alone
        large = [length for length in large if left[length]] if pairs or not left[longest] else large

    for length in sorted((length for length in left if left[length]), reverse=True):
        while n := left[length]:
            gap, first, count = gaps.take(length) or (capacity, sequences, -(-n // (capacity // length)))
            if first == sequences:
                sequences += count
            each = gap // length
            full = min(n // each, count)
            if full:
                place(length, full * each, first, capacity - gap, each)
                gaps.add(gap - full_size(each, length), first, full)
            rest = min(n - full * each, each) if full < count else 0
            if rest:
                place(length, rest, first + full, capacity - gap, rest)
                gaps.add(gap - rest * length, first + full, 1)
            gaps.add(gap, first + full + (rest > 0), count - full - (rest > 0))
    return runs


def full_size(each: int, length: int) -> int:
    return each * length


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_column: str = "doc_id", text: str = "text", kept_words: int = CACHED_WORDS) -> DataFrame:
    """One row per piece of at most ``capacity`` tokens: id, piece, start, length, ids_crc32."""
    schema = f"{id_column} {kind(docs, id_column)}, piece int, start bigint, length bigint, ids_crc32 bigint"
    names = [id_column, "piece", "start", "length", "ids_crc32"]

    def cut(batches):
        ids_of_each, end = tokenizer(path, kept_words).ids_of_each, np.uint32(end_id).astype("<u4").tobytes()
        for batch in batches:
            for part in slices(batch):
                owner, columns = [], ([], [], [], [])
                for i, ids in enumerate(ids_of_each(part.column(1))):
                    ids += end
                    for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[start : start + 4 * capacity]
                        owner.append(i)
                        for column, value in zip(columns, (piece, start // 4, len(own) // 4, zlib.crc32(own))):
                            column.append(value)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
                made = [part.column(0).take(pa.array(owner, pa.int64()))]
                made += [pa.array(c, k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays(made, names=names)

    return in_batches(docs.select(F.col(id_column), F.col(text).cast("string"))).mapInArrow(cut, schema)


def ranked(pieces: DataFrame, key: str, order: list[str], together: int) -> DataFrame:
    """``rank`` from 0 of each row among the rows of its key; a key of any size is dealt over many tasks.

    ``together``: the number of parts to deal each key into.
    """
    part = F.pmod(F.xxhash64(*order), F.lit(together))
    dealt = pieces.withColumn("_part", part)
    sizes = dealt.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(key, "_part").orderBy(*order)
    numbered = dealt.withColumn("_within", F.row_number().over(within) - 1)
    joined = numbered.join(starts, [key, "_part"])
    return joined.withColumn("rank", F.col("_before") + F.col("_within")).drop("_part", "_before", "_within")


def pack(docs: DataFrame, path: str, capacity: int, end_id: int, id_column: str = "doc_id", text: str = "text", kept_words: int = CACHED_WORDS) -> DataFrame:
    """Pack whole documents, each followed by ``end_id``, into sequences of at most ``capacity`` tokens.

    A worker keeps the ids of ``kept_words`` words; more cost memory and save time.

    Returns per piece: id, piece, start, length, ids_crc32, sequence_id, offset. Only documents longer
    than the capacity are cut. A null or empty text is one piece that holds the end id; null ids are kept;
    repeated rows are packed each; an empty table gives no rows; columns other than id and text are not read.
    """
    pieces = written(token_pieces(docs, path, capacity, end_id, id_column, text, kept_words), "pieces")
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    histogram = {row["length"]: row["n"] for row in counts}
    runs = sorted(plan_sequences(histogram, capacity))
    table = np.array(runs, dtype=np.int64).reshape(-1, len(Run._fields))
    starts = (table[:, 0] << RANK_BITS) + table[:, 1]

    @F.pandas_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length, rank):
        import pandas as pd

        at = np.searchsorted(starts, (length.to_numpy() << RANK_BITS) + rank.to_numpy(), side="right") - 1
        own = table[at]
        sequence, slot = np.divmod(rank.to_numpy() - own[:, 1], own[:, 5])
        return pd.DataFrame({"sequence_id": own[:, 3] + sequence, "offset": own[:, 4] + slot * own[:, 0]})

    parts = -(-max(histogram.values(), default=1) // RANKED_TOGETHER)
    order = [id_column, "piece", "ids_crc32"]
    placed = ranked(pieces, "length", order, parts).withColumn("_place", place("length", "rank"))
    return placed.select(id_column, "piece", "start", "length", "ids_crc32", "_place.sequence_id", "_place.offset")
