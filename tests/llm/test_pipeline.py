"""The pipeline's stages take effect and chain."""

from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language_id"](spark, docs, SF)
    assert first.columns == docs.columns and first.count() >= 0.98 * docs.count()
    second = stages["near_dedup"](spark, docs, SF)
    assert second.columns == docs.columns and second.select("text").distinct().count() == second.count() < docs.count()
    last = corpus_pipeline.run(spark, SF)
    rows = last.collect()
    assert all(r.round_trip for r in rows) and 0 < len(rows) < docs.count()


def test_edge_rows_and_names(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = {name: F.lit("mine") for name in ("_lang", "_score", "_found", "cdc", "_cdc", "_key", "_id", "_places", "id", "key")}
    some = docs.where("doc_id < 60").withColumns(extra)
    edge = some.limit(1).withColumns({"text": F.lit(None).cast("string"), "doc_id": F.lit(None).cast("long")})
    df = some.unionByName(edge).unionByName(edge.withColumn("text", F.lit(""))).unionByName(some.where("doc_id < 3"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, SF)
        rows = out.collect()
        assert out.columns == df.columns and rows and all(r[c] == "mine" for r in rows for c in extra), name
        assert stage(spark, df.where("false"), SF).isEmpty()
        nulls = sum(r.text is None for r in rows)
        assert nulls == (0 if name == "language_id" else 1), name
    assert corpus_pipeline.sentencepiece_codes(spark, df.where("false"), SF).isEmpty()
