import numpy as np

from veritrace.llm import quality_classifier as q


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.01"
    out = q.op6_quality_classifier(spark, at)
    labels = spark.read.parquet(f"{at}/labels.parquet")
    rows = out.where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 50 and np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_odd_rows(spark, odd, none, texts):
    labels = spark.createDataFrame([(1, 1), (8, 0), (6, None), (5, 7), (8, 0)], "doc_id long, quality int")
    out = q.quality_classifier(odd, labels).collect()
    assert len(out) == len(texts)
    same = {r["score"] for r in out if r["doc_id"] in (2, 3, 4)}
    assert len(same) == 1
    assert q.quality_classifier(none, labels).count() == 0
    assert {r["score"] for r in q.quality_classifier(odd, labels.limit(0)).collect()} == {0.5}


def test_batches_do_not_matter():
    rng = np.random.default_rng(0)
    model = rng.normal(size=q.BUCKETS), 0.1
    x = ["a b b", "word " * 50, None, "", "é ü \U0001f600", "x" * 10_000]
    whole = q.text_scores(x, model)
    assert np.allclose(whole, np.concatenate([q.text_scores([t], model) for t in x]))
    u, n = q.document_units(x[0])
    assert np.isclose(whole[0], 1 / (1 + np.exp(-(model[0][u] @ n / n.sum() + 0.1))))
