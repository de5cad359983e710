"""The pipeline's stages, each on what its predecessor kept, against plain versions."""

import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_operators import plain_fingerprint, plain_lines

import corpus_pipeline as pipeline


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark, corpus, tmp_path):
    stages = dict(pipeline.STAGES)
    corpus.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name in ("language", "line_dedup", "near_dedup", "personal_data"):
        before = rows(docs)
        stages[name](spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == corpus.columns
        after = rows(docs)
        kept.append((len(before), len(after)))
        if name == "language":
            assert all(r["text"] and any(c.isalpha() for c in r["text"]) for r in after.values()) and all(before[d] == r for d, r in after.items())
        if name == "line_dedup":
            assert {d: r["text"] for d, r in after.items()} == plain_lines(sorted((d, r["text"]) for d, r in before.items()))
        if name == "near_dedup":
            fps = {d: plain_fingerprint(r["text"]) for d, r in before.items()}
            assert all((fps[a] ^ fps[b]).bit_count() > 2 for a in after for b in after if a < b) and all(before[d] == r for d, r in after.items())
        if name != "language":
            assert all(r["n_chars"] == len(r["text"]) for d, r in after.items() if r != before[d])
    assert kept[1][0] == kept[1][1] and kept[3][0] == kept[3][1] and kept[2][1] < kept[2][0]
    pieces = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} == set(rows(docs)) and all(p["offset"] + p["length"] <= 2048 for p in pieces)


@pytest.mark.parametrize("name", ["language", "near_dedup", "personal_data", "packing"])
def test_python_workers_get_few_texts_at_once(name, spark, corpus, tmp_path):
    """a batch of 10,000 whole texts in two workers of an executor was too much for its memory."""
    held = {key: spark.conf.get(key) for key in pipeline.BATCHES}
    try:
        dict(pipeline.STAGES)[name](spark, corpus, str(tmp_path))

        def sizes(batches):
            for b in batches:
                yield pd.DataFrame({"rows": [len(b)], "bytes": [int(b["text"].str.len().sum())]})

        many = spark.range(3000, numPartitions=1).select(F.when(F.col("id") < 2000, "few words").otherwise(F.repeat(F.lit("long "), 20_000)).alias("text"))
        found = many.mapInPandas(sizes, "rows long, bytes long").collect()
        assert sum(r["rows"] for r in found) == 3000 and max(r["rows"] for r in found) <= 500 and max(r["bytes"] for r in found) < 6_000_000
    finally:
        for key, value in held.items():
            spark.conf.set(key, value)


def test_run_leaves_the_session_as_it_was(spark, corpus, tmp_path):
    corpus.write.parquet(f"{tmp_path}/documents.parquet")
    before = {key: spark.conf.get(key) for key in pipeline.BATCHES}
    assert pipeline.run(spark, str(tmp_path)).count() > 0
    assert {key: spark.conf.get(key) for key in pipeline.BATCHES} == before
