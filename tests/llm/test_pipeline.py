import corpus_pipeline
from mirador.llm import decontaminate, quality, simhash


def test_stages_follow_one_another(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "mixing sources", "sharding"]
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    # each stage against the operator's own verdicts on that stage's input
    first = corpus_pipeline.quality_stage(spark, docs, sf).cache()
    assert first.columns == names and ids(first) == sorted(r["doc_id"] for r in quality.op8_quality(docs).collect() if r["kept"])
    second = corpus_pipeline.near_duplicate_stage(spark, first, sf).cache()
    assert second.columns == names and ids(second) == sorted(r["doc_id"] for r in simhash.op7_simhash(first).collect() if r["doc_id"] == r["component_id"])
    third = corpus_pipeline.decontamination_stage(spark, second, sf).cache()
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    items = [decontaminate.normalised(r["text"]) for r in bench]
    leaked = {r["doc_id"] for r in second.collect() if any(i in decontaminate.normalised(r["text"]) for i in items)}
    assert leaked and set(ids(third)) == set(ids(second)) - leaked
    assert corpus_pipeline.ORACLE_SQL is None


def test_run(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert found and {r["shard"] for r in found} <= set(range(24)) and {"doc_id", "size", "shard", "slot"} <= set(found[0].asDict())
