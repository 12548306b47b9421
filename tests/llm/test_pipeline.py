import corpus_pipeline
from evidencelake.llm import exact_dedup, simhash
from evidencelake.llm.common import materialize
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, SF), name)
        assert out.columns == columns
        assert out.join(docs, columns, "left_anti").count() == 0
        if name == "exact":
            assert exact_dedup.exact_dedup(out).filter("group_size > 1").count() == 0
            assert out.count() == exact_dedup.exact_dedup(docs).filter("kept").count()
        if name == "near":
            assert simhash.simhash_groups(out).groupBy("component_id").count().filter("count > 1").count() == 0
        docs = out
    assert docs.count() < n
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.select("doc_id").distinct().count() == docs.count()


def test_stages_bear_odd_rows(spark, odd, none):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0
        assert stage(spark, odd, SF).count() > 0
    kept = corpus_pipeline.exact_stage(spark, odd, SF)
    assert kept.filter("doc_id = 8").count() == 1 and kept.filter(F.col("doc_id").isNull()).count() == 0
