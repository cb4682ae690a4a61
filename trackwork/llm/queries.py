"""Registered queries of the operators, with the parameters of production use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackwork.llm.chat import ROTATE_SQL, rotate
from trackwork.llm.decontaminate import contaminated
from trackwork.llm.hard_negatives import MINE_SQL, mine
from trackwork.llm.html_text import extract
from trackwork.llm.jaccard import Similarity, jaccard_components
from trackwork.llm.license_scan import scan_licenses
from trackwork.llm.materialise import KEPT_WORDS, materialise, shard_folder
from trackwork.llm.nearest import nearest
from trackwork.llm.packing import pack
from trackwork.llm.prefix_trie import TRIE_SQL, prefix_trie
from trackwork.llm.quality import THRESHOLD, scored
from trackwork.llm.tables import table
from trackwork.llm.token_counts import count_tokens
from trackwork.llm.tokens import vocabulary
from trackwork.llm.toxicity import toxicity

WORD_BPE = "word_bpe_49k.json"
SEQUENCE_TOKENS = 4096
END_ID = 1
COUNT_LIMIT = 2048
ORDER_KEY, ORDER_TOKENS = 20_240_917, 8192


def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the view of each of its speakers."""
    return rotate(table(spark, sf_dir, "conversations"))


def op2_html_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of four-word shingles agree to 85 in 100."""
    return jaccard_components(table(spark, sf_dir, "documents"), Similarity(words=4, share=85))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and whether there are more than 2,048."""
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE), COUNT_LIMIT)


def op5_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier keeps, with their chance of being bad."""
    scores = scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.where(F.col("reject_score") < THRESHOLD)


def op6_block_matrix_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors, by cosine, of every vector whose id is divisible by 50."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4,096 tokens."""
    return pack(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE), SEQUENCE_TOKENS, END_ID, kept_words=KEPT_WORDS)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_benchmark_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item or more."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token shards in permuted order, and where each sequence went."""
    docs = table(spark, sf_dir, "documents")
    return materialise(docs, vocabulary(WORD_BPE), shard_folder(spark), length=ORDER_TOKENS, end_id=END_ID, key=ORDER_KEY)


def op11_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How toxic every document is."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every vector whose id is divisible by 100, for each of its 5 positives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, relabelled=label)


QUERIES = {f.__name__: f for f in (
        op1_perspective_rotation,
        op2_html_tree_scoring,
        op3_ngram_jaccard_join,
        op4_token_counts,
        op5_weak_label_quality,
        op6_block_matrix_neighbours,
        op7_best_fit_packing,
        op8_license_scan,
        op9_benchmark_tiling,
        op10_training_order,
        op11_string_kernel_toxicity,
        op12_prefix_trie,
        op13_hard_negatives,
    )}

#: The others read markup, tokens or trained models; tests compare them with brute force.
ORACLE: dict[str, str] = {"op1_perspective_rotation": ROTATE_SQL, "op12_prefix_trie": TRIE_SQL, "op13_hard_negatives": MINE_SQL}
