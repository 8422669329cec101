"""The per-transfer scorer that groups are compared with: history aggregates, vectors, equal budgets, blindness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import ratio

NAMES = ["log_amount", "hour", "log_sent", "log_sent_mean", "sent_ratio", "log_out_peers", "log_received", "log_received_mean", "received_ratio", "log_in_peers"]


def aggregates(history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per sender and per receiver: transfers, mean amount, distinct counterparties, of the fitting period alone."""
    amount = F.col("amount").cast("double")
    sent = history.groupBy("src").agg(F.count("*").alias("sent"), F.avg(amount).alias("sent_mean"), F.countDistinct("dst").alias("out_peers"))
    got = history.groupBy("dst").agg(F.count("*").alias("received"), F.avg(amount).alias("received_mean"), F.countDistinct("src").alias("in_peers"))
    return sent, got


def vectors(ledger: DataFrame, history: DataFrame) -> DataFrame:
    """Every transfer with its ten features; an account without history has zeros."""
    sent, got = aggregates(history)
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    amount = F.col("amount").cast("double")
    rows = ledger.join(sent, "src", "left").join(got, "dst", "left")
    made = [F.log1p(amount), F.hour("ts").cast("double"), F.log1p(zero("sent")), F.log1p(zero("sent_mean")), ratio(amount, zero("sent_mean")), F.log1p(zero("out_peers")), F.log1p(zero("received")), F.log1p(zero("received_mean")), ratio(amount, zero("received_mean")), F.log1p(zero("in_peers"))]
    return rows.select("txn_id", "ts_us", "src", "dst", "amount", "is_laundering", "pattern_id", *[c.alias(n) for c, n in zip(made, NAMES, strict=True)])


def _placed(scored: DataFrame) -> DataFrame:
    """The rows with ``rank`` from 1 by score, ties by id."""
    from ledgerloom.operators.evaluate import rank

    return rank(scored.withColumns({"w": F.lit(0).cast("long"), "first_txn": F.col("txn_id")})).drop("w", "first_txn")


def flag_top(scored: DataFrame, budget: int) -> DataFrame:
    """The ``budget`` transfers of highest score, ties by id."""
    return _placed(scored).where(F.col("rank") <= budget).drop("rank")


def compare(scored: DataFrame, group_flagged: DataFrame, rings: DataFrame) -> DataFrame:
    """(side, flagged, hits, rings_found) of groups and rows at an equal budget: as many transfers as the groups flag in the pool."""
    pool = group_flagged.select("txn_id").distinct().join(scored, "txn_id")
    rows = flag_top(scored, pool.count())
    both = pool.select("txn_id", "is_laundering", "pattern_id", F.lit("groups").alias("side")).unionByName(rows.select("txn_id", "is_laundering", "pattern_id", F.lit("rows").alias("side")))
    sizes = scored.where("pattern_id > 0").groupBy("pattern_id").agg(F.count("*").alias("ring_txns"))
    hit = both.where("pattern_id > 0").groupBy("side", "pattern_id").agg(F.count("*").alias("n")).join(sizes.join(rings, "pattern_id", "left_semi"), "pattern_id")
    found = hit.where(2 * F.col("n") >= F.col("ring_txns")).groupBy("side").agg(F.count("*").alias("rings_found"))
    each = both.groupBy("side").agg(F.count("*").alias("flagged"), F.count(F.when(F.col("is_laundering"), 1)).alias("hits"))
    return each.join(found, "side", "left").withColumn("rings_found", F.coalesce("rings_found", F.lit(0)))


def percentiles(scored: DataFrame, order: Column | None = None) -> DataFrame:
    """(txn_id, pattern_id, pct): place by score from the riskiest, over the number of transfers; ties by id."""
    placed = _placed(scored)
    n = scored.agg(F.count("*").alias("n"))
    return placed.join(F.broadcast(n)).withColumn("pct", F.col("rank") / F.col("n")).select("txn_id", "pattern_id", "is_laundering", "pct")


def blindness(placed: DataFrame, edge: float = 0.10) -> DataFrame:
    """(pattern_id, txns, best, median, seen): how a ring's transfers are placed; the median is the upper one, seen counts those within the edge."""
    order = Window.partitionBy("pattern_id").orderBy("pct")
    ring = placed.where("pattern_id > 0").withColumn("i", F.row_number().over(order) - 1)
    n = placed.where("pattern_id > 0").groupBy("pattern_id").agg(F.count("*").alias("txns"))
    rows = ring.join(n, "pattern_id")
    return rows.groupBy("pattern_id", "txns").agg(F.min("pct").alias("best"), F.max(F.when(F.col("i") == F.expr("txns div 2"), F.col("pct"))).alias("median"), F.count(F.when(F.col("pct") <= edge, 1)).alias("seen"))


def heroes(ledger: DataFrame, placed: DataFrame, members: DataFrame, ranked: DataFrame, least: int = 5, most: int = 14, edge: float = 0.10, limit: int = 1) -> DataFrame:
    """Rings the row scorer is blind to and an alert covers by half: most transfers first, then the lowest id."""
    size = F.count("*")
    ring = ledger.where("pattern_id > 0").groupBy("pattern_id").agg(size.alias("txns"), F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("loops"))
    ring = ring.where((F.col("txns") >= least) & (F.col("txns") <= most) & (3 * F.col("loops") <= F.col("txns")))
    seen = placed.where("pattern_id > 0").groupBy("pattern_id").agg(F.count(F.when(F.col("pct") <= edge, 1)).alias("seen"))
    cover = members.where("pattern_id > 0").groupBy("w", "first_txn", "pattern_id").agg(size.alias("hit")).join(ranked.select("w", "first_txn", "rank"), ["w", "first_txn"])
    fit = ring.join(seen, "pattern_id").where("seen = 0").join(cover, "pattern_id").where("2 * hit >= txns")
    return fit.groupBy("pattern_id", "txns").agg(F.min("rank").alias("rank")).orderBy(F.col("txns").desc(), "pattern_id").limit(limit)
