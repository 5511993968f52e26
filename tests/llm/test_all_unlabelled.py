"""The quality classifier learns from all unlabelled rows: many blocks against one place, reruns, and rows that only a whole pass sees."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonora.llm import quality


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    good, bad = [f"word{i}" for i in range(60)], ["#", "$$", "x9", "&", "|", "<<", "77"]
    rows = [(i, " ".join(rng.choice(good if i % 5 else bad, int(rng.integers(8, 60))))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id").sortWithinPartitions("doc_id")
    labels = spark.createDataFrame([(i, 1) for i in range(1500) if i % 5 and i % 7 == 0] + [(0, 0)], "doc_id long, quality int")
    return docs, labels


def test_blocks_reach_the_risk_of_one_place(table, monkeypatch):
    docs, labels = table
    monkeypatch.setattr(quality, "BLOCK", 200)
    model = quality.fit(docs, labels)
    assert model.prior == pytest.approx(0.8, abs=0.12)
    x = np.stack([quality.features(r["text"]) for r in docs.orderBy("doc_id").collect()])
    p = x[[i for i in range(1500) if i % 5 and i % 7 == 0]]
    sp, su = (quality._stand(v, model.mean, model.scale) for v in (p, x))
    here = quality.non_negative_pu(sp, su, model.prior)

    def risk(w):
        loss = lambda z: np.logaddexp(0, -z).mean()
        return model.prior * loss(sp @ w) + max(0.0, loss(-(su @ w)) - model.prior * loss(-(sp @ w)))

    assert risk(model.weights) < risk(here) + 0.05
    score = model.score(x)
    assert score[np.arange(1500) % 5 > 0].min() > score[np.arange(1500) % 5 == 0].max()


def test_reruns_agree(table, monkeypatch):
    docs, labels = table
    monkeypatch.setattr(quality, "BLOCK", 300)
    one, two = (quality.fit(docs, labels) for _ in range(2))
    assert (one.weights == two.weights).all() and one.prior == two.prior


def test_every_row_teaches(spark, table, monkeypatch):
    """Rows of a kind that stands in one block only still move the weights."""
    docs, labels = table
    monkeypatch.setattr(quality, "BLOCK", 100)
    more = docs.unionByName(spark.range(5000, 5060).select(F.col("id").alias("doc_id"), F.lit("ÄÖÜ ÄÖÜ ÄÖÜ ÄÖÜ").alias("text")))
    strange = quality.features("ÄÖÜ ÄÖÜ ÄÖÜ ÄÖÜ")[None]
    assert quality.fit(more, labels).score(strange)[0] < quality.fit(docs, labels).score(strange)[0]


def test_packed_features_score_alike(table):
    docs, labels = table
    rows = quality.packed(docs, ["doc_id"])
    model = quality.fit(rows, labels)
    a = {r["doc_id"]: r["score"] for r in quality.rate_packed(rows, model, ["doc_id"]).collect()}
    b = {r["doc_id"]: r["score"] for r in quality.rate(docs, model, ["doc_id"]).collect()}
    assert a.keys() == b.keys() and max(abs(a[i] - b[i]) for i in a) < 0.02
