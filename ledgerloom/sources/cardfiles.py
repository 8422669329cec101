"""Readers of card transaction and identity files by header name; blocks of numbered columns become arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import device_fingerprint, exact_decimal, null_number, null_text

#: Blocks of numbered columns, and which identity columns hold numbers.
BLOCKS = {"c_counts": ("C", 14, "float"), "d_deltas": ("D", 15, "float"), "m_flags": ("M", 9, "string"), "v_features": ("V", 339, "float")}
NUMERIC_IDS = frozenset([*range(1, 12), 13, 14, *range(17, 23), 24, 25, 26, 32])


def _raw(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def _text(df: DataFrame, name: str) -> Column:
    """A column by name; one that the file lacks reads as empty."""
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def _packed(df: DataFrame, prefix: str, n: int, kind: str) -> Column:
    each = [_text(df, f"{prefix}{i}") for i in range(1, n + 1)]
    return F.array(*[null_text(c) if kind == "string" else null_number(c, kind) for c in each])


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    df = _raw(spark, path)
    number = lambda name, kind: null_number(_text(df, name), kind)
    return df.select(
        number("TransactionID", "int").alias("transaction_id"), (_text(df, "isFraud") == "1").alias("is_fraud"), number("TransactionDT", "int").alias("transaction_dt"),
        exact_decimal(_text(df, "TransactionAmt"), 12, 3).alias("transaction_amt"), null_text(_text(df, "ProductCD")).alias("product_cd"),
        number("card1", "int").alias("card1"), *[number(f"card{i}", "short").alias(f"card{i}") for i in (2, 3, 5)], *[null_text(_text(df, f"card{i}")).alias(f"card{i}") for i in (4, 6)],
        *[number(f"addr{i}", "short").alias(f"addr{i}") for i in (1, 2)], *[number(f"dist{i}", "float").alias(f"dist{i}") for i in (1, 2)],
        null_text(_text(df, "P_emaildomain")).alias("p_emaildomain"), null_text(_text(df, "R_emaildomain")).alias("r_emaildomain"),
        *[_packed(df, *block).alias(name) for name, block in BLOCKS.items()],
    )


def read_identities(spark: SparkSession, path: str) -> DataFrame:
    df = _raw(spark, path)
    ids = []
    for i in range(1, 39):
        c = _text(df, f"id_{i:02d}")
        ids.append((null_number(c, "float") if i in NUMERIC_IDS else null_text(c)).alias(f"id_{i:02d}"))
    return df.select(null_number(_text(df, "TransactionID"), "int").alias("transaction_id"), *ids, null_text(_text(df, "DeviceType")).alias("device_type"), null_text(_text(df, "DeviceInfo")).alias("device_info"))


def cards(transactions: DataFrame, identities: DataFrame) -> DataFrame:
    """(transaction_id, is_fraud, transaction_dt, card1, addr1, d1, device) for ``entity.resolve``.

    ``device`` is null without an identity that names both the device and its browser; a transaction with several
    identities has a row for each.
    """
    named = identities.where("device_info IS NOT NULL AND id_31 IS NOT NULL")
    devices = named.select("transaction_id", device_fingerprint(*map(F.col, ("device_info", "id_30", "id_31", "id_33"))).alias("device"))
    thin = transactions.select("transaction_id", "is_fraud", "transaction_dt", "card1", "addr1", F.get("d_deltas", F.lit(0)).alias("d1"))
    return thin.join(devices, "transaction_id", "left")


def report(transactions: DataFrame) -> DataFrame:
    return transactions.agg(F.count("*").alias("transactions"), F.count(F.when(F.col("is_fraud"), 1)).alias("fraud"), F.min("transaction_amt").alias("least"), F.max("transaction_amt").alias("most"))
