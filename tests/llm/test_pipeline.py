"""The stages of the corpus pipeline on a small table, each on what the one before kept."""

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages(spark, sf, tmp_path):
    kept = {}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert sorted(docs.columns) == sorted(columns)
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
        kept[name] = docs
    texts = {n: {r.doc_id: r.text for r in kept[n].select("doc_id", "text").collect()} for n in list(kept)[:4]}
    assert len(texts["near_duplicates"]) < len(texts["language_id"])
    assert len(set(texts["near_duplicates"].values())) == len(texts["near_duplicates"])
    found = kept["near_duplicates"].select("doc_id").subtract(kept["benchmark_decontamination"].select("doc_id")).count()
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    whole = {d for d, t in texts["near_duplicates"].items() if any(x in t for x in items)}
    assert whole <= set(texts["near_duplicates"]) - set(texts["benchmark_decontamination"]) and found >= len(whole)
    assert set(texts["secret_scan"]) == set(texts["benchmark_decontamination"])
    assert not any("token = \"" in t and "[SECRET]" not in t for t in texts["secret_scan"].values())
    packed = kept["best_fit_packing"]
    assert packed.select("doc_id").distinct().count() == len(texts["secret_scan"])
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024
