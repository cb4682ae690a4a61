"""The corpus pipeline: each stage reads what its predecessor kept and passes on what it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwork.llm.decontaminate import contaminated
from trackwork.llm.jaccard import Similarity, jaccard_components
from trackwork.llm.packing import pack
from trackwork.llm.quality import accepted
from trackwork.llm.queries import END_ID, SEQUENCE_TOKENS, WORD_BPE
from trackwork.llm.sketches import without
from trackwork.llm.tables import table, written
from trackwork.llm.tokens import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier does not reject."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id; all without an id.

    Five words to a shingle and a similarity of 0.8. Of rows with equal id and text one stays.
    """
    found = written(jaccard_components(docs, Similarity(words=5, share=80)), "near-duplicates")
    known = found.where("doc_id is not null")
    gone = known.where("component_id <> doc_id").select("doc_id", "text_hash")
    repeated = known.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return without(docs, "doc_id", "text", gone, repeated)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without half of any benchmark item."""
    found = written(contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "text_hash"), "contaminated")
    return without(docs, "doc_id", "text", found)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of at most 4,096 tokens."""
    return pack(docs, vocabulary(WORD_BPE), SEQUENCE_TOKENS, END_ID)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL has no tokenizer and no trained scorer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
