"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe_prefix, jaccard, language_id, licenses, mixing, mtree, packed_tokens, quality, secrets, token_counts
from ledgerloom.llm.runtime import ready


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    sample = language_id.learn(docs.where(fold != 2))
    return language_id.identify(docs, sample, keep={"held_out": F.coalesce(fold == 2, F.lit(False))})


def op2_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = packed_tokens.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return packed_tokens.read_documents(files)


def op3_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.written("base_spans"), 256).alias("base_sha256"), secrets.written("spans").alias("spans"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.ledger(quality.measure(_table(spark, sf_dir, "documents")))
    base = F.col("fail_bits").bitwiseAND(F.lit(quality.BASE_MASK)) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), quality.passes("v1").alias("kept"), "fail_bits")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule removes under every policy, from the stored ledger of all documents."""
    book = quality.ledger(quality.measure(_table(spark, sf_dir, "documents")))
    each = [quality.ablations(book, p).select(F.lit(p).alias("policy"), "rule", "n_failed", "n_alone", "n_kept_without") for p in quality.POLICIES]
    return each[0].unionByName(each[1])


def op9_bpe_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe_prefix.encode(_table(spark, sf_dir, "documents"), ranks, pattern, decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents")).drop("notices")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language, op2_packed_tokens, op3_mtree, op4_secrets, op5_mixing, op6_token_counts, op7_jaccard, op8_quality, op9_bpe_prefix, op10_licenses, quality_ablations)}


_TOP = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""


_WORDS = r"[^\x20\x09-\x0D]+"
_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW.format("coalesce(text, '')")}, '{_WORDS}') AS w FROM documents),
g AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)
    UNION SELECT doc_id, len(w) || ' ' || array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4
),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""

_LEDGER = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) >= 5)),
h AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k FROM g) WHERE k > 1),
p AS (SELECT doc_id, sum(least(5, coalesce(j, i + 5) - i)) AS n FROM h GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORDS}')) AS ls FROM d),
m AS (
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, length(t) - length(replace(t, '!', '')) AS n_excl, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_caps
    FROM d JOIN l USING (doc_id) LEFT JOIN p USING (doc_id)
),
b AS (
    SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT + 8 * (4 * n_excl > n_words)::INT + 16 * (2 * n_dup_lines > n_lines)::INT
        + 32 * (2 * n_caps > word_chars)::INT + 64 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT AS BIGINT) AS fail_bits FROM m
)"""
_QUALITY = f"{_LEDGER} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b"
_ABLATIONS = f"""{_LEDGER},
r(rule, flag) AS (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('exclamations', 8), ('repeated_lines', 16), ('capitals', 32), ('word_length', 64)),
y(policy, mask) AS (VALUES ('base', 3), ('v1', 127))
SELECT policy, rule, count(*) FILTER (fail_bits & flag <> 0) AS n_failed, count(*) FILTER (fail_bits & mask = flag) AS n_alone, count(*) FILTER (fail_bits & mask & ~flag = 0) AS n_kept_without
FROM b, r, y WHERE flag & mask <> 0 GROUP BY policy, rule
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express a query; the others are tested against plain Python."""
    return {"op3_mtree": _TOP, "op7_jaccard": _JACCARD, "op8_quality": _QUALITY, "quality_ablations": _ABLATIONS}
