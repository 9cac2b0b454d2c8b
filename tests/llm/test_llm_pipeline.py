"""The pipeline's stages on given and on hostile tables."""

from __future__ import annotations

import corpus_pipeline
import hostile
from test_llm_near_dup import brute
from test_llm_decontaminate import runs

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, scratch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [runs(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.schema.simpleString() == docs.schema.simpleString()
        path = scratch(name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = docs.collect()
    rejected = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    kept = {r.doc_id for r in seen["quality"]}
    assert len(rejected & kept) <= 0.2 * len(rejected) and len(kept) >= 150
    links, want = brute({r.doc_id: r.text for r in seen["quality"]})
    assert {r.doc_id for r in seen["near_duplicates"]} == set(want.values())
    leaks = {r.doc_id for r in seen["near_duplicates"] if any(len(runs(r.text) & b) >= 0.8 * len(b) for b in bench)}
    assert leaks and {r.doc_id for r in seen["decontamination"]} == {r.doc_id for r in seen["near_duplicates"]} - leaks
    assert len(seen["personal_data"]) == len(seen["decontamination"])
    assert not any("@mail" in r.text and ".example.com" in r.text for r in seen["personal_data"])
    assert all(r.n_chars == len(r.text) for r in seen["personal_data"] if "[" in r.text)
    assert {r.doc_id for r in seen["packing"]} == {r.doc_id for r in seen["personal_data"]}


def test_run_equals_its_stages_and_hostile_tables_pass(spark, scratch, hostile_docs, no_docs):
    assert corpus_pipeline.run(spark, SF).count() > 0
    folder = scratch("sf")
    for table in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{table}.parquet").write.parquet(f"{folder}/{table}.parquet")
    hostile_docs.write.parquet(f"{folder}/documents.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        docs = stage(spark, docs, folder)
        assert docs.columns == hostile_docs.columns, name
    assert docs.count() <= len(hostile.rows())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, folder).count() == 0
