"""The pipeline's stages, each judged on its own input, and the registered queries' columns."""

from itertools import combinations

import pytest
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline as pipeline
from trackwork.llm.shingles import shingle_set
from trackwork.llm.tokens import vocabulary

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_perspective_rotation": "conv_id bigint, perspective string, part int, n_turns int, text string, targets string, n_target_chars int",
    "op2_html_tree_scoring": "page_id bigint, url string, text string, n_chars bigint",
    "op3_ngram_jaccard_join": "doc_id bigint, n_shingles bigint, component_id bigint, text_hash bigint",
    "op4_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op5_weak_label_quality": "doc_id bigint, reject_score double",
    "op6_block_matrix_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op7_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op8_license_scan": "doc_id bigint, license string, template int, coverage double, first int, last int",
    "op9_benchmark_tiling": "doc_id bigint, item_id bigint, coverage double, n_tiles int, tiles array<struct<item_at:int,doc_at:int,words:int>>, text_hash bigint",
    "op10_training_order": "slot bigint, shard int, offset bigint, n_tokens int, ids_crc32 bigint, doc_ids array<bigint>",
    "op11_string_kernel_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op12_prefix_trie": "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string",
    "op13_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_of_queries(spark, name):
    df = contract.queries()[name](spark, SF_DIR)
    assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == COLUMNS[name]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").selectExpr("*", "lang AS likely", "n_chars AS _hash", "1 AS reject_score")
    twice = docs.where("doc_id = 7")
    nameless = docs.limit(2).selectExpr("CAST(null AS bigint) AS doc_id", *docs.columns[1:])
    empty = docs.where("doc_id = 8").selectExpr("doc_id + 100000 AS doc_id", "CAST(null AS string) AS text", *docs.columns[2:])
    docs.union(twice).union(nameless).union(empty).write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF_DIR}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return folder


def test_each_stage_on_its_own_input(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    kept = pipeline.quality(spark, docs, corpus)
    assert kept.columns == docs.columns
    labels = {r.doc_id: r for r in spark.read.parquet(f"{corpus}/labels.parquet").collect()}
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    clean = [i for i, r in labels.items() if r.quality and not r.toxic]
    assert sum(i in ids for i in clean) >= 0.97 * len(clean)
    assert sum(r.doc_id in ids for r in labels.values() if not r.quality) <= 0.3 * sum(not r.quality for r in labels.values())

    rows = docs.select("doc_id", "text").collect()
    unique = pipeline.near_duplicates(spark, docs, corpus)
    assert unique.columns == docs.columns
    left = [r.doc_id for r in unique.select("doc_id").collect()]
    assert left.count(7) <= 1 and left.count(None) == 2
    sets = {r.doc_id: set(shingle_set((r.text or "").encode(), 5).tolist()) for r in rows if r.doc_id is not None}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            top[y] = x
    assert sorted(i for i in left if i is not None) == sorted(i for i in sets if find(i) == i)

    found = pipeline.decontamination(spark, docs, corpus)
    assert found.columns == docs.columns
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{corpus}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in rows if any(i in " ".join((r.text or "").lower().split()) for i in items)}
    cleaned = {r.doc_id for r in found.select("doc_id").collect()}
    assert leaked - {None} and not (leaked - {None}) & cleaned
    assert len(cleaned) >= len({r.doc_id for r in rows}) - len(leaked) - 2

    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    packed = pipeline.packing(spark, docs, corpus)
    want = sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in rows)
    assert packed.agg({"length": "sum"}).first()[0] == want


def test_run_applies_the_stages_in_order(spark, corpus):
    assert [n for n, _ in pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "packing"]
    out = pipeline.run(spark, corpus)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert 0 < out.select("doc_id").distinct().count() < spark.read.parquet(f"{corpus}/documents.parquet").count()


def test_empty_documents(spark, corpus, tmp_path):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where("false")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, corpus).count() == 0
