"""The stages of the corpus pipeline, each on its own input, and all in turn."""

from __future__ import annotations

import corpus_pipeline as pipeline
import pytest
from test_operators import component_ids, docs_of

from sonora.llm import queries
from sonora.llm.common import read


@pytest.fixture(scope="module")
def documents(spark):
    return read(spark, "/root/testdata/sf0.01", "documents")


def test_stage_names():
    assert [n for n, _ in pipeline.STAGES] == ["language", "quality", "near_duplicates", "mixing", "packing"]


def test_filters_keep_clean_documents(spark, documents):
    d = "/root/testdata/sf0.01"
    left = pipeline.language_stage(spark, documents, d)
    assert left.columns == documents.columns and left.count() > 0.98 * documents.count()
    good = pipeline.quality_stage(spark, documents, d).select("doc_id")
    labels = read(spark, d, "labels")
    assert labels.filter("quality = 1").join(good, "doc_id", "left_anti").count() <= 0.02 * labels.filter("quality = 1").count()
    assert labels.filter("quality = 0").join(good, "doc_id").count() <= 0.1 * labels.filter("quality = 0").count()


def test_dedup_stage(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    ids, _ = component_ids([(r["doc_id"], r["text"]) for r in docs.collect()])
    left = {r["doc_id"] for r in pipeline.dedup_stage(spark, docs, sf_dir).collect()}
    assert left == {i for i, c in ids.items() if i == c}


def test_stages_on_odd_rows(spark, sf_dir):
    rows = [(1, None, None, None), (2, "", "en", "a"), (None, "alpha beta gamma", "en", None), (3, "alpha beta gamma", "en", None)]
    for docs in (docs_of(spark, rows), docs_of(spark, [])):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert name == "packing" or out.columns == docs.columns
            out.count()


def test_run(spark, sf_dir):
    out = pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rows = out.toPandas()
    assert len(rows) and rows.groupby("sequence_id")["length"].sum().max() <= 2048
    assert rows.groupby(["doc_id", "piece"]).size().max() <= 2


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 11)} == {n.split("_")[0] + "_" for n in names if n.startswith("op") and n[2].isdigit()}
    assert "pipeline" in names and set(queries.QUERIES) <= names
