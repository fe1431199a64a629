"""The pipeline's stages on the smallest tables."""

from __future__ import annotations

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts, seen = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen, SF)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        counts.append(out.count())
        seen = corpus_pipeline.settled(out, "test")
    assert counts[0] >= counts[1] > counts[2] > counts[3] > 0 and counts[4] == counts[5]


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "text", "shard", "virtual_slot"} <= set(out.columns) and out.count() > 0
