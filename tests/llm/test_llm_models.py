"""The classifiers: held-out accuracy, and what they do without labels or texts."""

import zlib

import pytest
from pyspark.sql import functions as F

from linkloom.llm import contract, quality, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def held_out(spark):
    rows = spark.read.parquet(f"{SF}/labels.parquet").collect()
    return {r.doc_id: r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}


def test_quality_on_held_out_documents(spark, held_out):
    got = contract.op2_quality(spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    known = [(r.score, r.predicted, held_out[r.doc_id].quality) for r in got if r.doc_id in held_out]
    assert sum(p == q for _, p, q in known) / len(known) > 0.98
    good, bad = [s for s, _, q in known if q], [s for s, _, q in known if not q]
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.98


def test_toxicity_on_held_out_documents(spark, held_out):
    got = {r.doc_id: r for r in contract.op6_toxicity(spark, SF).collect()}
    known = [(got[i].toxic, r.toxic, r.quality) for i, r in held_out.items()]
    found = [p for p, t, _ in known if t]
    assert sum(found) / len(found) > 0.8
    assert sum(p for p, t, _ in known if not t) / len(known) < 0.01
    good = [got[i].p_toxic_good > 0.5 for i, r in held_out.items() if r.toxic and r.quality]
    assert sum(good) / len(good) > 0.85


def test_the_last_link_decides_and_hears_the_earlier_ones(spark):
    """The words say who is meant and what is said; only both together are the last category."""
    rows = [(i, f"{'red' if i & 1 else 'blue'} {'up' if i & 2 else 'down'} w{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i & 1, i >> 1 & 1) for i, _ in rows if i % 5], "doc_id long, red int, up int")
    red, up = F.col("red") == 1, F.col("up") == 1
    chain = toxicity.fit(docs, labels, {"first": red & up, "second": ~red & ~up, "either": red == up})
    got = toxicity.score(docs, chain).collect()
    # Equal and unequal pairs can't be told apart by adding up words; the earlier links can tell them.
    assert all(r.toxic == ((r.doc_id & 1) == (r.doc_id >> 1 & 1)) for r in got)
    assert all((r.toxic == 1) == (r.either >= 0.5) for r in got)


def _categories():
    return {"p": F.col("toxic") == 1, "q": (F.col("toxic") == 1) & (F.col("quality") == 1)}


def test_models_on_odd_rows(docs, no_docs, labels):
    model = quality.fit(docs, labels)
    assert quality.score(docs, model).count() == docs.count()
    assert quality.score(no_docs, model).count() == 0
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    predicted = quality.score(docs, model).filter("predicted = 1").groupBy("doc_id").count().count()
    assert kept.groupBy("doc_id").count().count() == predicted
    chain = toxicity.fit(docs, labels, _categories())
    got = toxicity.score(docs, chain)
    assert got.columns == ["doc_id", "p", "q", "toxic"] and got.count() == docs.count()
    assert toxicity.score(no_docs, chain).count() == 0


def test_models_without_labels(docs, no_docs, labels):
    for texts, known, prior in (
        (docs, labels.filter("false"), 0.5), (no_docs, labels, None), (docs, labels.filter("quality = 1"), 1.0),
    ):
        model = quality.fit(texts, known)
        scores = {r.score for r in quality.score(docs, model).select("score").distinct().collect()}
        assert len(scores) == 1 and (prior is None or scores == {prior})
    chain = toxicity.fit(docs, labels.filter("false"), _categories())
    assert toxicity.score(docs, chain).filter("toxic = 1").count() == 0
