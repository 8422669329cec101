import hashlib

import numpy as np
import public_tokenizers as P
from helpers import components, quality
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import queries

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, rows = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    good = corpus_pipeline.quality_stage(spark, docs, DIR)
    kept = {r["doc_id"] for r in good.collect()}
    for i, r in rows.items():
        w, chars, sym, dup, rep = quality(r["text"])
        if w < 10 or 100 * rep > 20 * w or 10 * sym > w:
            assert i not in kept
    assert good.columns == columns and len(kept) > 100
    one = corpus_pipeline.near_copies_stage(spark, good, DIR)
    ids = sorted(kept)
    want = {ids[c] for c in set(components([rows[i]["text"] for i in ids]))}
    assert {r["doc_id"] for r in one.collect()} == want and one.columns == columns
    clean = corpus_pipeline.secrets_stage(spark, one, DIR)
    assert {r["doc_id"] for r in clean.collect()} == want and clean.columns == columns and clean.where(F.col("text").rlike("[0-9a-f]{32}")).count() == 0
    mix = corpus_pipeline.mixing_stage(spark, clean, DIR)
    n = mix.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert mix.columns == columns and 1 <= n <= 3
    last = corpus_pipeline.encode_stage(spark, mix, DIR).collect()
    assert len(last) == mix.count()
    texts = {r["doc_id"]: r["text"] for r in mix.collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() and len(np.frombuffer(r["ids"], "<u4")) == r["n_tokens"] for r in last)


def test_run(spark):
    out = corpus_pipeline.run(spark, DIR)
    assert out.count() > 50 and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "secrets", "mixing", "encode"]


def test_queries_are_ten():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op")) == list(range(1, 11)) and P.PATTERN
