import zlib

import numpy as np
import pytest

from echometer.llm import quality
from tests.llm.conftest import EDGES

SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    return quality.fit(quality.training_sample(docs, labels))


def test_held_out_accuracy(spark, fitted):
    scores = quality.score(spark.read.parquet(f"{SF01}/documents.parquet"), fitted)
    rows = scores.join(spark.read.parquet(f"{SF01}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert rows and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    y = np.array([r.quality for r in rows])
    s = np.array([r.score for r in rows])
    pos, neg = s[y == 1], s[y == 0]
    auc = (pos[:, None] > neg[None, :]).mean() + 0.5 * (pos[:, None] == neg[None, :]).mean()
    accuracy = ((s >= quality.THRESHOLD) == (y == 1)).mean()
    assert auc >= 0.9 and accuracy > max(y.mean(), 1 - y.mean())


def test_sample_never_holds_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    sample = quality.training_sample(docs, spark.read.parquet(f"{SF01}/labels.parquet"), size=50).collect()
    assert 0 < len(sample) <= 50
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 != 0 for r in sample)


def test_spark_scores_equal_the_model(spark, fitted, texts):
    docs = spark.createDataFrame(texts[:60], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.score(docs, fitted).collect()}
    expected = fitted.score([t for _, t in texts[:60]])
    assert np.allclose([got[i] for i, _ in texts[:60]], expected)


def test_edges(spark, edges, nothing, fitted):
    rows = quality.score(edges, fitted).collect()
    assert len(rows) == len(EDGES)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    same = [r.score for r in rows if r.doc_id == 3]
    assert len(same) == 2 and same[0] == same[1]
    assert [r.held_out for r in rows if r.doc_id is None] == [False, False]
    assert quality.score(nothing, fitted).count() == 0


def test_no_labels_gives_half(spark, edges):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(quality.training_sample(edges, labels))
    assert {round(r.score, 6) for r in quality.score(edges, model).collect()} == {0.5}
