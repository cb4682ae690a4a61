"""Token files in training order (operator 10).

Tasks cut their documents' tokens into sequences of equal length. A keyed Feistel permutation over
the sequences' numbers gives each its slot; the slots are range-partitioned into shards, and each
shard is a file in which slot ``i`` starts at ``i * stride``. A reader needs no index: it seeks to the
slot where it stopped and reads on.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackwork.llm.tables import in_batches, kind, written
from trackwork.llm.tokens import slices, tokenizer

#: A record: the number of tokens, then the ids, then zeros up to the length of a sequence.
HEAD = np.dtype("<u4")
ROUNDS = 6
#: Words whose ids a worker keeps, about 90 MB, and as many pieces of words at most; with few of them a quarter of all words is encoded again.
KEPT_WORDS = 600_000
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _round_keys(key: int) -> list[np.uint64]:
    state, keys = key & (2**64 - 1), []
    for _ in range(ROUNDS):
        state = (state + 0x9E3779B97F4A7C15) & (2**64 - 1)
        keys.append(np.uint64(state))
    return keys


def permuted(numbers: np.ndarray, count: int, key: int) -> np.ndarray:
    """Places of ``numbers`` (0 <= x < count) in a permutation of ``range(count)`` chosen by ``key``.

    The network works on the smallest even number of bits that holds ``count``; a value beyond it
    walks on along its cycle until it is inside, so each place is used once.
    """
    half = np.uint64(max(1, (max(count - 1, 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = _round_keys(key)

    def network(values):
        left, right = values >> half, values & mask
        for k in keys:
            mixed = (right + k) * _MIX
            mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(32))) & mask)
        return (left << half) | right

    with np.errstate(over="ignore"):
        out = network(numbers.astype(np.uint64))
        while (outside := out >= np.uint64(count)).any():
            out[outside] = network(out[outside])
    return out.astype(np.int64)


def token_sequences(docs: DataFrame, path: str, length: int, end_id: int, id_column: str, text: str, width: str) -> DataFrame:
    """Whole sequences of each task's documents, in their order, the ids compressed one sequence at a time.

    Columns: task, number, n_tokens, ids, ids_crc32, doc_ids.
    """
    names = ["task", "number", "n_tokens", "ids", "ids_crc32", "doc_ids"]
    schema = f"task int, number bigint, n_tokens int, ids binary, ids_crc32 bigint, doc_ids array<{kind(docs, id_column)}>"

    def cut(batches):
        ids_of_each, wide = tokenizer(path, KEPT_WORDS).ids_of_each, np.dtype("<u4")
        end = np.array([end_id], dtype=wide).tobytes()
        task, number, size = TaskContext.get().partitionId(), 0, length * wide.itemsize
        held, owners, out = bytearray(), [], ([], [], [], [], [])
        pack = zstandard.ZstdCompressor(level=3).compress

        def take(n):
            nonlocal number
            own = np.frombuffer(bytes(held[:n]), dtype=wide).astype(width).tobytes()
            for column, value in zip(out, (number, n // wide.itemsize, pack(own), zlib.crc32(own), list(owners))):
                column.append(value)
            number += 1
            del held[:n]
            owners[:] = owners[-1:] if held else []

        def flush():
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.list_(id_type))
            columns = [pa.array([task] * len(out[0]), pa.int32()), *(pa.array(c, k) for c, k in zip(out, kinds))]
            for column in out:
                column.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            for part in slices(batch):
                for owner, ids in zip(part.column(0).to_pylist(), ids_of_each(part.column(1))):
                    owners.append(owner)
                    held += ids + end
                    while len(held) >= size:
                        take(size)
                    if len(out[0]) * size > 1 << 24:
                        yield flush()
                yield flush()
        if held:
            take(len(held))
        yield flush()

    return in_batches(docs.select(F.col(id_column), F.col(text).cast("string"))).mapInArrow(cut, schema)


def materialise(
    docs: DataFrame,
    path: str,
    folder: str,
    length: int = 8192,
    end_id: int = 1,
    key: int = 0,
    shard_slots: int = 2048,
    id_column: str = "doc_id",
    text: str = "text",
    width: str = "<u2",
) -> DataFrame:
    """Write all documents' tokens as shards of fixed-stride records in permuted order.

    Each document is followed by ``end_id`` and sequences run on over document ends; only the last
    sequence of a task may be short. ``folder`` is a place that all executors reach, ``shard-00000000.bin``
    is the first file in it. Returns per sequence: slot, shard, offset (bytes), n_tokens, ids_crc32,
    doc_ids (whose tokens it holds, in order; null ids are kept). ``width`` must hold the largest id.
    A null or empty text is its end id; repeated rows are written each; an empty table gives no files.
    """
    made = written(token_sequences(docs, path, length, end_id, id_column, text, width), "sequences", "uncompressed")
    per_task = made.groupBy("task").agg(F.count(F.lit(1)).alias("n"))  # a row for each task: small enough to send
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_task.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    count = made.count()

    @F.pandas_udf("bigint")
    def slot_of(numbers):
        import pandas as pd

        return pd.Series(permuted(numbers.to_numpy(), count, key))

    placed = made.join(F.broadcast(starts), "task").withColumn("slot", slot_of(F.col("first") + F.col("number")))
    shards = max(1, -(-count // shard_slots))
    stride = HEAD.itemsize + length * np.dtype(width).itemsize
    shard_of = F.floor(F.col("slot") / shard_slots).cast("int")
    ordered = placed.select(shard_of.alias("shard"), "slot", "n_tokens", "ids", "ids_crc32", "doc_ids")
    # Slots are dense, so equal ranges of them are equal parts and need no sample.
    ordered = ordered.repartitionById(shards, "shard").sortWithinPartitions("slot")
    schema = f"slot bigint, shard int, offset bigint, n_tokens int, ids_crc32 bigint, doc_ids array<{kind(docs, id_column)}>"

    def write(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        attempt = TaskContext.get().taskAttemptId()
        shard, file, name = None, None, ""
        unpack = zstandard.ZstdDecompressor().decompress

        def finish():
            if file is not None:
                file.close()
                store.move(f"{name}.{attempt}", name)  # a repeated task writes the same bytes

        store.create_dir(base, recursive=True)
        for batch in batches:
            offsets = []
            for own, slot, n, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if own != shard:
                    finish()
                    shard, name = own, f"{base}/shard-{own:08d}.bin"
                    file = store.open_output_stream(f"{name}.{attempt}")
                file.write(np.array([n], dtype=HEAD).tobytes() + unpack(ids).ljust(stride - HEAD.itemsize, b"\0"))
                offsets.append((slot - own * shard_slots) * stride)
            columns = [batch.column(1), batch.column(0), pa.array(offsets, pa.int64()), *(batch.column(i) for i in (2, 4, 5))]
            yield pa.RecordBatch.from_arrays(columns, names=["slot", "shard", "offset", "n_tokens", "ids_crc32", "doc_ids"])
        finish()

    return written(in_batches(ordered).mapInArrow(write, schema), "manifest")


def read_slots(folder: str, first: int, count: int, length: int = 8192, shard_slots: int = 2048, width: str = "<u2"):
    """Ids of the sequences in slots ``first`` and up, by one sequential read per shard."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    stride = HEAD.itemsize + length * np.dtype(width).itemsize
    slot, end = first, first + count
    while slot < end:
        shard = slot // shard_slots
        upto = min(end, (shard + 1) * shard_slots)
        with store.open_input_file(f"{base}/shard-{shard:08d}.bin") as file:
            file.seek((slot - shard * shard_slots) * stride)
            for _ in range(upto - slot):
                record = file.read(stride)
                if len(record) < stride:
                    return
                n = int(np.frombuffer(record, HEAD, 1)[0])
                yield np.frombuffer(record, width, n, HEAD.itemsize)
        slot = upto


def shard_folder(spark: SparkSession) -> str:
    """A new folder for shards in the shared one, as a URI."""
    from trackwork.session import scratch_path

    path = scratch_path(spark, "shards")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
