"""The corpus pipeline: stages, columns, and what each drops."""

import hashlib
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from apsidal.llm import exact_dedup, quality, simhash_dedup


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("note", F.lit("x"))
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, sf_dir).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
        ids = Counter(r[0] for r in after.select("doc_id").collect())
        had = Counter(r[0] for r in before.select("doc_id").collect())
        assert set(ids) <= set(had)
        if name == "quality_rules":
            want = quality.quality_verdicts(before, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept")
            assert ids == Counter(r.doc_id for r in want.collect())
        elif name == "exact_dedup":
            assert ids == Counter(r.doc_id for r in exact_dedup.exact_dedup(before).where("kept").collect())
        elif name == "simhash_near_dedup":
            assert set(ids) == {r[0] for r in simhash_dedup.simhash_near_dedup(before).select("component_id").distinct().collect()}
        elif name == "source_mixing":
            assert max(ids.values()) == 2
        else:
            assert ids == had
        before = after


def test_near_copies_of_repeated_and_null_ids(spark):
    long = " ".join(f"w{i}" for i in range(400))
    near = next(t for i in range(400) for t in [long + f" x{i}"] if (simhash_dedup.simhash64(t) ^ simhash_dedup.simhash64(long)).bit_count() <= 2)
    clean = " ".join(f"v{i}" for i in range(300))
    pair = [" ".join(f"u{i}" for i in range(400)), None]
    pair[1] = next(t for i in range(400) for t in [pair[0] + f" x{i}"] if (simhash_dedup.simhash64(t) ^ simhash_dedup.simhash64(pair[0])).bit_count() <= 2)
    rows = [(1, long), (2, near), (2, clean), (None, near), (None, long), (3, pair[0]), (3, pair[1]), (4, "only"), (4, "only"), (None, "no id"), (None, "no id"), (5, ""), (6, None)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, note int").repartition(3)
    got = Counter((r.doc_id, r.text) for r in simhash_dedup.drop_near_copies(docs).collect())
    kept = min(pair, key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert got == Counter([(1, long), (2, clean), (3, kept), (4, "only"), (None, "no id"), (5, "")])
    assert simhash_dedup.drop_near_copies(docs).columns == docs.columns


def test_empty(spark, sf_dir, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
