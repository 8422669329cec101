"""Tiny ledgers: (id, hours, from, to, amount)."""

from __future__ import annotations

from ledgerloom.config import HOUR_US

SCHEMA = "txn_id long, ts_us long, src string, dst string, amount double, payment_format string, is_laundering boolean, pattern_id long, typology string"


def ledger(spark, rows, laundering=(), patterns=None):
    patterns = patterns or {}
    made = [(i, round(h * HOUR_US), str(a), str(b), float(x), "ACH", i in laundering, patterns.get(i, 0), "CYCLE" if i in patterns else None) for i, h, a, b, x in rows]
    return spark.createDataFrame(made, SCHEMA)


def members(spark, rows):
    """The rows as the members of one candidate."""
    from pyspark.sql import functions as F

    return ledger(spark, rows).withColumns({"w": F.lit(0).cast("long"), "first_txn": F.lit(1).cast("long"), "window_start": F.lit(0).cast("long")})
