"""Classifiers: held-out accuracy, the prior, what is never read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.llm import pu, quality, toxicity

SF = "/root/testdata/sf0.1"


def test_prior_from_counts_by_bin():
    rnd = np.random.default_rng(0)
    positive = pu.bins(1 / (1 + np.exp(-rnd.normal(3, 1, 2000))))
    mixed = pu.bins(1 / (1 + np.exp(-np.concatenate([rnd.normal(3, 1, 3000), rnd.normal(-3, 1, 7000)]))))
    assert abs(pu.class_prior(positive, mixed) - 0.3) < 0.05


def test_risk_stays_non_negative_and_separates():
    rnd = np.random.default_rng(0)
    p = rnd.normal(2, 1, (300, 2))
    u = np.concatenate([rnd.normal(2, 1, (200, 2)), rnd.normal(-2, 1, (800, 2))])
    scores = pu.fit(p, u, 0.2).score(u)
    assert (scores[:200] > 0.5).mean() > 0.9 and (scores[200:] < 0.5).mean() > 0.95


def _judged(spark, operator, label):
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scores = operator(documents, labels)
    assert scores.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = scores.where("held_out").join(labels.select("doc_id", F.col(label).alias("label")), "doc_id").collect()
    yes, no = ([r for r in rows if r.label == k] for k in (1, 0))
    return sum(r.predicted for r in yes) / len(yes), sum(r.predicted for r in no) / len(no)


def test_quality_on_held_out_labels(spark):
    recall, false = _judged(spark, quality.quality_scores, "quality")
    assert recall > 0.95 and false < 0.1


def test_toxicity_on_held_out_labels(spark):
    recall, false = _judged(spark, toxicity.toxicity_scores, "toxic")
    assert recall > 0.9 and false < 0.03


@pytest.mark.parametrize("operator, label", [(quality.quality_scores, "quality"), (toxicity.toxicity_scores, "toxic")])
def test_small_and_odd_tables(spark, operator, label):
    docs = spark.createDataFrame([(1, "good words", "a"), (None, None, "b"), (2, "", "c"), (2, "", "c")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    assert sorted(r.score for r in operator(docs, none).collect()) == [0, 0, 0, 0]
    some = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (2, 0)], f"doc_id long, {label} int")
    rows = operator(docs, some).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert operator(docs.limit(0), some).count() == 0


def test_held_out_labels_are_not_read(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r.doc_id: r.score for r in toxicity.toxicity_scores(documents, x).collect()} for x in (labels, turned))
    assert one == two
