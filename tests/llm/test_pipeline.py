import corpus_pipeline
from veritrace.llm import near_copies, simhash


def test_stages(spark):
    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, at)
        assert after.columns == docs.columns and after.count() <= kept.count()
        assert after.join(docs, docs.columns, "left_anti").count() == 0
        kept = after
    assert simhash.simhash_groups(kept).groupBy("component_id").count().where("count > 1").count() == 0
    out = corpus_pipeline.run(spark, at)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in kept.collect()}


def test_one_row_of_each_group(odd):
    rows = near_copies.one_of_each(odd).collect()
    assert sorted(r["doc_id"] for r in rows if r["doc_id"] is not None)[:2] == [1, 2]
    assert sum(r["doc_id"] in (2, 3, 4) for r in rows) == 1 and sum(r["doc_id"] == 1 for r in rows) == 1


def test_stages_take_odd_rows_and_empty_tables(spark, odd, none, tmp_path):
    from pyspark.sql import functions as F

    labels = spark.createDataFrame([(1, 1), (5, 1), (8, 0), (9, None)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    named = odd.withColumn("lang", F.when(F.col("doc_id").isin(1, 5, 9), "en"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, named, str(tmp_path))
        assert out.count() <= named.count() or name == "pack"
        assert name == "pack" or out.columns == named.columns
        empty = stage(spark, none, str(tmp_path))
        assert empty.columns == out.columns and empty.count() == 0
