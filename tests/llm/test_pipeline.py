"""The pipeline on the smallest tables: each stage's decisions take effect."""

import os

import pytest

import corpus_pipeline
from strandline.llm import decontamination, jaccard, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.durable(stage(spark, kept[-1], SF), f"test-{name}")
        assert out.columns[: len(columns)] == columns
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        kept.append(out)
    ids = [sorted(r["doc_id"] for r in d.select("doc_id").collect()) for d in kept]
    scores = toxicity.score_toxicity(kept[0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids[1] == sorted(r["doc_id"] for r in scores.filter("predicted = 0").collect())
    classes = jaccard.jaccard_classes(kept[1]).collect()
    assert ids[2] == sorted({r["class_id"] for r in classes})
    hits = decontamination.contamination(kept[2], spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids[3] == sorted(r["doc_id"] for r in hits.filter("not contaminated").collect())
    assert set(ids[4]) <= set(ids[3]) and ids[5] == ids[4]
    last = kept[-1].toPandas()
    assert not last.duplicated(["shard", "slot"]).any()
    sizes = last.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
