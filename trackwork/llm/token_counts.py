"""Token counts of whole texts (operator 4)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackwork.llm.tables import in_batches, kind
from trackwork.llm.tokens import BATCH_BYTES, tokenizer


def balanced(sizes: list[int], limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each; a longer text is a range by itself."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def count_tokens(docs: DataFrame, path: str, limit: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row, without begin, end or padding tokens.

    Only ids, byte lengths and counts leave the Arrow function. A null or empty text has 0 tokens; a
    null id is kept; repeated rows are counted each; an empty table gives none; other columns are not read.
    """
    schema = f"{id_column} {kind(docs, id_column)}, n_bytes bigint, n_tokens bigint"

    def counted(batches):
        import pyarrow.compute as pc

        count = tokenizer(path).counts
        for batch in batches:
            texts = batch.column(1)
            sizes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            tokens: list[int] = []
            for start, end in balanced(sizes.to_pylist()):
                tokens += count(texts.slice(start, end - start).to_pylist())
            columns = [batch.column(0), sizes, pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_column, "n_bytes", "n_tokens"])

    rows = in_batches(docs.select(F.col(id_column), F.col(text).cast("string"))).mapInArrow(counted, schema)
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
