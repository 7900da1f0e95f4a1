"""The corpus pipeline, stage by stage, against what each stage must keep."""

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from rasterloom.llm import decontam


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    kept = pipeline.STAGES[0][1](spark, docs, small).cache()
    assert kept.columns == docs.columns
    good = labels.filter("quality = 1").join(docs, "doc_id", "left_semi")
    assert good.join(kept, "doc_id", "left_semi").count() >= 0.97 * good.count()

    lined = pipeline.STAGES[1][1](spark, kept, small).cache()
    assert lined.columns == docs.columns and lined.join(kept, "doc_id", "left_anti").isEmpty()
    assert lined.filter(F.length("text") != F.col("n_chars")).count() == kept.filter(F.length("text") != F.col("n_chars")).count()

    single = pipeline.STAGES[2][1](spark, lined, small).cache()
    assert single.select("text").filter("length(text) > 60").count() == single.select("text").filter("length(text) > 60").distinct().count()

    clean = pipeline.STAGES[3][1](spark, single, small).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    found = decontam.Items(items, 0.25)
    for r in single.collect():
        leaks = bool(found.leaks([r.text])[0])
        assert leaks == clean.filter(F.col("doc_id") == r.doc_id).isEmpty()

    coded = pipeline.STAGES[4][1](spark, clean, small)
    assert coded.count() == clean.count() and coded.filter("not round_trip").isEmpty()


def test_empty_corpus(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0
