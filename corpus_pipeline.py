"""A corpus pipeline over ``documents``: quality rules, near copies, secrets, source mix, token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; ``run`` writes each stage's
rows as Parquet to the shared folder and reads them again. All stages but the last return the columns of ``documents``.

- quality: documents that the policy ``v1`` of the quality ledger rejects go.
- near_copies: of each group of documents whose five-word shingles overlap by 80 %, the one with the smallest id stays.
- secrets: every reported span becomes a mark; no document goes.
- mixing: each document stays as often as the mix takes it, up to three times; some aren't taken.
- encode: the ids of every text, little-endian unsigned 32-bit, and whether they decode to the text again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe_prefix, jaccard, mixing, quality, secrets
from ledgerloom.llm.runtime import materialise, ready


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, "v1")


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.drop_near_copies(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    made = bpe_prefix.encode(docs, ranks, pattern, decoded=True)
    return made.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality_stage),
    ("near_copies", near_copies_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("encode", encode_stage),
]

#: Components, Newton iterations and BPE merges are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
