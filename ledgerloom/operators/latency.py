"""Exact latency summaries and the time from a transfer to the decision of its first window."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import Detector
from ledgerloom.operators.detect import origin_of
from ledgerloom.operators.evaluate import running


def summary(rows: DataFrame, value: str) -> DataFrame:
    """One row (n, mean, p50, p95, p99, least, most); percentiles are exact, by nearest rank: the least value that a share of
    the rows does not exceed. Values are counted, and their places come from a range-partitioned running sum."""
    known = rows.where(F.col(value).isNotNull())
    facts = known.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    placed = running(known.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("m")), [], "v", "m")
    rank = lambda q: F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(q) - 1e-9))
    at = lambda q: F.max(F.when((F.col("before") < rank(q)) & (rank(q) <= F.col("before") + F.col("m")), F.col("v")))
    places = placed.join(F.broadcast(facts.select("n"))).agg(at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))
    return facts.join(F.broadcast(places)).select("n", "mean", "p50", "p95", "p99", "least", "most")


def decision_times(ledger: DataFrame, cfg: Detector) -> DataFrame:
    """Every transfer with ``wait_us`` from its arrival to the close of the first window that holds it (null: uncovered) and
    ``steady``: whether windows were closing all the while."""
    o = origin_of(ledger)
    t = ledger.join(F.broadcast(o))
    since = F.col("ts_us") - F.col("origin")
    low = F.greatest(F.lit(0).cast("long"), F.floor((since - cfg.width) / F.lit(cfg.stride)).cast("long") + 1)
    start = F.col("origin") + low * cfg.stride
    covered = (start <= F.col("ts_us")) & (start <= F.col("last"))
    return t.withColumns({"wait_us": F.when(covered, start + cfg.width - F.col("ts_us")), "steady": F.col("ts_us") >= F.col("origin") + cfg.width - cfg.stride}).drop("origin", "last")


def decision_summary(ledger: DataFrame, cfg: Detector) -> DataFrame:
    """Two rows, all transfers and those of the steady state: (scope, uncovered, n, mean, p50, ...)."""
    t = decision_times(ledger, cfg)
    out = None
    for scope, rows in (("all", t), ("steady", t.where("steady"))):
        row = summary(rows, "wait_us").join(F.broadcast(rows.agg(F.count(F.when(F.col("wait_us").isNull(), 1)).alias("uncovered")))).withColumn("scope", F.lit(scope))
        out = row if out is None else out.unionByName(row)
    return out


def amortised(windows: DataFrame) -> DataFrame:
    """Windows (w, txns, process_ns) with the cost of a transfer, empty windows left out."""
    return windows.where("txns > 0").withColumn("ns_per_txn", F.col("process_ns") / F.col("txns"))


def timer_floor(samples: int = 20_000) -> list[int]:
    """What two readings of the clock in a row are apart, sorted."""
    out = []
    for _ in range(samples):
        a = time.perf_counter_ns()
        out.append(time.perf_counter_ns() - a)
    return sorted(out)
