"""A ledger of transfers and a table of card transactions derived from the driver's tables, by fixed arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import SHAPES, micros


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(txn_id, ts, ts_us, src, dst, amount, payment_format, is_laundering, pattern_id, typology) of every event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = e.agg((F.max("user_id") + 1).alias("n"))
    k = F.get_json_object("props", "$.k").cast("long")
    ring = (F.col("event_type") == "purchase") & (F.col("user_id") % 10 == 3)
    pattern = F.when(ring, F.floor(F.col("user_id") / 10) * 4 + F.floor((F.dayofmonth("ts") - 1) / 8) + 1).otherwise(0).cast("long")
    account = lambda user, spread: F.concat(F.lit("U"), user.cast("string"), F.lit("|"), spread.cast("string"))
    other = (F.col("user_id") * 7 + F.col("event_id") * 13) % F.col("n")
    rows = e.join(F.broadcast(n)).select(  # one row
        (F.col("event_id") + 1).alias("txn_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), micros(F.col("ts")).alias("ts_us"),
        account(F.col("user_id"), F.col("event_id") % 4).alias("src"), account(other, F.floor(F.col("event_id") / 4) % 4).alias("dst"),
        F.col("value").cast("decimal(20,2)").alias("amount"), F.col("event_type").alias("payment_format"),
        (ring | F.coalesce(k % 25 == 7, F.lit(False))).alias("is_laundering"), pattern.alias("pattern_id"),
    )
    shape = F.element_at(F.array(*map(F.lit, SHAPES)), (F.col("pattern_id") % 8 + 1).cast("int"))
    return rows.withColumn("typology", F.when(F.col("pattern_id") > 0, shape))


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(transaction_id, is_fraud, transaction_dt, card1, addr1, d1, device) of every order."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").join(spark.read.parquet(f"{sf_dir}/customer.parquet"), F.col("o_custkey") == F.col("c_custkey"))
    device = F.when(F.col("o_orderkey") % 5 == 0, "generic").otherwise(F.concat(F.lit("dev"), F.floor(F.col("o_custkey") / 2).cast("string")))
    start = F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")
    return o.select(
        F.col("o_orderkey").alias("transaction_id"), (F.col("o_orderkey") % 29 == 0).alias("is_fraud"),
        F.timestamp_diff("SECOND", start, F.col("o_orderdate").cast("timestamp_ntz")).alias("transaction_dt"),
        F.col("o_custkey").alias("card1"), F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("c_nationkey")).alias("addr1"),
        (F.col("o_orderkey") % 3).alias("d1"), F.when(F.col("o_orderkey") % 3 != 1, device).alias("device"),
    )
