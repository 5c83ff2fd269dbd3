"""Quality and toxicity: held-out accuracy, the fit itself, odd rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import quality, queries, toxicity, training

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def test_quality_on_the_held_out_fold(spark, labels):
    got = queries.QUERIES["op1_quality"](spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    rows = [(r.score, labels[r.doc_id].quality) for r in got if r.held_out and r.doc_id in labels]
    good, bad = ([s for s, y in rows if y == v] for v in (1, 0))
    auc = np.mean([(np.array(good) > b).mean() for b in bad])
    assert auc > 0.97 and np.mean([(s >= 0.3) == y for s, y in rows]) > 0.93


def test_toxicity_on_the_held_out_fold(spark, labels):
    got = queries.QUERIES["op7_toxicity"](spark, SF).collect()
    rows = [(r.toxic, labels[r.doc_id].toxic) for r in got if r.doc_id in labels and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([t for t, y in rows if y]) > 0.85 and np.mean([t for t, y in rows if not y]) < 0.02


def test_labels_of_the_held_out_fold_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    sample = training.labelled_sample(docs, labels, "quality", 50, 20_000)
    assert 0 < sample.count() <= 100 and sample.where(training.held_out()).count() == 0
    flipped = labels.withColumn("quality", F.when(training.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit(sample) == quality.fit(training.labelled_sample(docs, flipped, "quality", 50, 20_000))


def test_ordinal_grades_in_order():
    rng = np.random.default_rng(0)
    texts, grades = [], []
    for _ in range(300):
        n = int(rng.integers(0, 12))
        texts.append(" ".join(["bad"] * n + [f"w{rng.integers(0, 30)}" for _ in range(30)]))
        grades.append(0 if n < 2 else 1 if n < 5 else 2 if n < 9 else 3)
    model = toxicity.fit(toxicity.Texts.of(texts), grades)
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()

    def severity(text):
        b, v = toxicity.features(text)
        return model.severity(float((model.weights[b] * v).sum()))

    curve = [severity("bad " * n + "other words") for n in (0, 3, 6, 11)]
    assert curve == sorted(curve) and curve[0] < 0.4 and curve[-1] > 2.4
    assert np.mean([abs(severity(t) - g) < 0.8 for t, g in zip(texts, grades)]) > 0.9


def test_gradient_descends_to_the_grade_shares():
    model = toxicity.fit(toxicity.Texts.of(["same words"] * 100), [0] * 60 + [1] * 30 + [2] * 10)
    assert model.severity(0.0) == pytest.approx(0.4 + 0.1, abs=0.05)
    assert toxicity.fit(toxicity.Texts.of([]), []).severity(0.0) < 1e-9 and toxicity.fit(toxicity.Texts.of(["a"]), [1]).severity(0.0) > 0.99


def test_monotone_curve():
    at, value = training.fit_monotone(np.array([3.0, 1.0, 2.0, 4.0]), np.array([0.0, 0.0, 1.0, 1.0]), prior=0)
    assert at.tolist() == [1.0, 2.5, 4.0] and value.tolist() == [0.0, 0.5, 1.0]


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, 0, 1), (7, 1, 0), (None, 1, 1), (2, None, None), (3, 7, 7)], "doc_id bigint, quality int, toxic int")
    got = quality.quality(odd_docs, labels)
    assert got.count() == 10 and got.where("score BETWEEN 0 AND 1").count() == 10 and got.where("held_out IS NULL").count() == 0
    assert quality.quality(no_docs, labels).count() == 0
    assert {r.score for r in quality.quality(odd_docs, labels.limit(0)).collect()} == {0.5}
    scored = toxicity.toxicity(odd_docs, labels)
    assert scored.count() == 10 and scored.where("severity IS NULL").count() == 0
    assert toxicity.toxicity(odd_docs, labels.limit(0)).where("toxic").count() == 0
    assert toxicity.toxicity(no_docs, labels).count() == 0
    model = toxicity.fit(toxicity.Texts.of(["a"]), [0])
    assert toxicity.severity(odd_docs, model).columns == [*odd_docs.columns, "severity"]


def test_few_labels(spark):
    """Quality from the small table, cross-fitted; toxicity from too few texts rejects nothing."""
    small = "/root/testdata/sf0.01"
    quality_of = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    rows = [(r.score, quality_of[r.doc_id]) for r in queries.QUERIES["op1_quality"](spark, small).collect() if r.held_out and r.doc_id in quality_of]
    good, bad = ([s for s, y in rows if y == v] for v in (1, 0))
    assert np.mean([(np.array(good) > b).mean() + 0.5 * (np.array(good) == b).mean() for b in bad]) > 0.95
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    few = labels.where("toxic = 0").unionByName(labels.where("toxic = 1").limit(3))
    assert toxicity.toxicity(docs, few).where("severity <> 0 OR toxic").count() == 0


def test_the_sample_is_bounded(spark):
    """In rows when one id has many, and in characters without leaving out long texts."""
    docs = spark.range(50_000).selectExpr("IF(id < 49990, 1, id) AS doc_id", "concat('text ', id) AS text")
    long = spark.createDataFrame([(2, "ab" * 50_000), (3, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, *range(49_990, 50_000))], "doc_id bigint, quality int")
    sample = training.labelled_sample(docs.unionByName(long), labels, "quality", 100, 800).collect()
    assert len(sample) == len({r.doc_id for r in sample}) <= 13 and 1 in {r.doc_id for r in sample}
    (text,) = [r.text for r in sample if r.doc_id == 2]
    assert len(text) == 800 + training.PIECES - 1 and set(text) == {"a", "b", " "}
    again = training.labelled_sample(docs.unionByName(long).repartition(7), labels, "quality", 100, 800).collect()
    assert sorted(map(tuple, sample)) == sorted(map(tuple, again))
