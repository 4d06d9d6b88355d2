"""Registered queries against their SQL, and the pipeline, on the smallest tables."""

import pytest
from compare import compare, connect

import corpus_pipeline
from lumisweep.llm.common import settle
from lumisweep.llm.oracle import ORACLE_SQL
from lumisweep.llm.queries import QUERIES

COLUMNS = {
    "op4_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op5_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op9_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    ok, note = compare(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE_SQL[name])
    assert ok, note


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_covers_its_table(spark, sf_dir, name):
    found = QUERIES[name](spark, sf_dir)
    table = "pages" if name == "op4_url_filter" else "documents"
    assert set(COLUMNS[name]) <= set(found.columns)
    assert found.count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, sf_dir, documents):
    """Each stage does what its operator says, on documents with known answers."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = documents([(10 ** 6, None), (10 ** 6 + 1, "1 2 3"), (10 ** 6 + 2, "the ring " + bench)])
    docs = table.unionByName(own.drop("size"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf_dir))
        kept[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name != "mixing sources":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    languages, near, repeats, clean, mixed = (kept[n] for n, _ in corpus_pipeline.STAGES)
    assert not languages & {10 ** 6, 10 ** 6 + 1} and 10 ** 6 + 2 in languages
    assert near < languages and repeats <= near and clean < repeats and mixed == clean
    assert 10 ** 6 + 2 not in clean


def test_pipeline_of_nothing(spark, sf_dir, documents):
    docs = documents([]).drop("size")
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, sf_dir))
    assert docs.count() == 0
