"""The pipeline against each stage's own law, on its own input."""

import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import decontamination, language_id, near_dedup, quality_rules

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "near-dedup", "decontamination", "byte-level BPE"]
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, SF)
        rows = {r.doc_id: r for r in out.collect()}
        before = {r.doc_id: r for r in at.collect()}
        assert rows and set(rows) <= set(before)
        if name != "byte-level BPE":
            assert out.columns == docs.columns and all(rows[d] == before[d] for d in rows)
        if name == "quality rules":
            model = quality_rules.fit(at, spark.read.parquet(f"{SF}/labels.parquet"))
            assert set(rows) == {r.doc_id for r in quality_rules.judge(at, model).where("kept").collect()}
        elif name == "language ID":
            model = language_id.fit(at.where(~language_id.held_out()))
            assert set(rows) == {r.doc_id for r in language_id.identify(at, model).where("accepted").collect()} and len(rows) > 0.9 * len(before)
        elif name == "near-dedup":
            from test_llm_operators import slow_clusters

            assert set(rows) == {d for d, v in slow_clusters([(d, r.text) for d, r in before.items()], 5, 80).items() if v[2]}
            assert near_dedup.clusters(out, 5).where("not kept").count() == 0
        elif name == "decontamination":
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert decontamination.report(out, bench).where("contaminated").count() == 0
        else:
            assert set(rows) == set(before)
            assert all(r.decoded_sha256 == hashlib.sha256(before[d].text.encode()).hexdigest() for d, r in rows.items())
        at = spark.createDataFrame([before[d] for d in sorted(rows)], docs.schema) if name != "byte-level BPE" else out


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 50 and "n_tokens" in got.columns


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, repeated rows, extra columns with the outputs' names, and a table without rows."""

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clash = {"n_words": "a", "score": "b", "kept": "c", "accepted": "d", "items": "e", "component_id": "f", "node": "g"}
    for name, value in clash.items():
        docs = docs.withColumn(name, F.lit(value))
    odd = docs.unionByName(docs.limit(5)).unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string"))).unionByName(docs.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, odd, sf)
        assert made.columns == odd.columns
        rows = made.collect()
        assert rows and all(r[c] == v for r in rows for c, v in clash.items())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.where("false"), sf).collect() == []
