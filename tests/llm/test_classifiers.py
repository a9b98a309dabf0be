import numpy as np
import pytest
from pyspark.sql import functions as F

from launchlens.llm import quality, queries, toxicity
from launchlens.llm.common import read

SF = "/root/testdata/sf0.01"
ROWS = [(1, None, "x", 1), (2, "", "x", 1), (3, " \n\t", "x", 1), (4, "fine words. " * 20_000, "x", 1), (5, "an idiot here.", "x", 1),
        (5, "an idiot here.", "x", 1), (None, "one two. three", "x", 1)]
SCHEMA = "doc_id long, text string, score string, sentences int"


@pytest.mark.parametrize("query, label, modulus, rest, least", [
    (queries.op4_quality, "quality", 5, 0, 0.95), (queries.op5_toxicity, "toxic", 3, 1, 0.9)])
def test_held_out_accuracy(spark, query, label, modulus, rest, least):
    got = query(spark, SF)
    assert got.count() == read(spark, SF, "documents").count()
    rows = got.join(read(spark, SF, "labels"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r[label] for r in rows]) >= least
    assert all(0 <= r.score <= 1 for r in rows)
    assert {bool(r.held_out) for r in got.select("held_out").distinct().collect()} == {True, False}


def test_toxic_sentences_are_located(spark):
    good, bad = "the day is fine. we walk home. ", "what an idiot. "
    texts = [good * (i % 5 + 1) + (bad if i % 3 == 0 else "") + good for i in range(150)]
    model = toxicity.fit(texts, [int(i % 3 == 0) for i in range(150)])
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {r.doc_id: r for r in toxicity.toxicity(df, model).collect()}
    assert got[1].score == got[2].score == got[3].score == 0 and got[4].score < 0.5 and got[5].score > 0.7
    assert [(s.start, s.end) for s in got[5].sentences] == [(0, 14)]
    assert toxicity.toxicity(df, model).count() == len(ROWS) and toxicity.toxicity(df.limit(0), model).count() == 0


def test_noisy_or_is_the_product_over_sentences():
    model = toxicity.Model()
    model.w[:] = 0.1
    model.b = np.float32(-1)
    z = model.logits(["a", "b", "c"])
    assert np.isclose(-np.expm1(-np.logaddexp(0, z).sum()), 1 - np.prod(1 - 1 / (1 + np.exp(-z))))


def test_word_vectors_count_both_neighbours(spark):
    df = spark.createDataFrame([("a b",), ("b c b",), (None,), ("z",)], "text string")
    index = quality.index_vectors().astype(float)
    bucket = {w: int(quality.tokens([w])[0][0]) for w in "abcz"}
    want = np.zeros((quality.BUCKETS, quality.WIDTH))
    for x, y in [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("c", "b"), ("b", "c")]:
        want[bucket[x]] += index[bucket[y]]
    used = [bucket[w] for w in "abc"]
    want[used] /= np.linalg.norm(want[used], axis=1, keepdims=True)
    want[used] -= want[used].mean(axis=0)
    assert np.allclose(quality.word_vectors(df), want, atol=1e-6)


def test_quality_edges(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    labels = spark.createDataFrame([(5, 1), (4, 0), (9, None), (None, 1)], "doc_id long, quality int")
    vectors, net = quality.train(df, labels, F.lit(True))
    got = quality.quality(df, vectors, net).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    none = quality.train(df.limit(0), labels.limit(0), F.lit(True))
    assert quality.quality(df, *none).count() == len(ROWS)
