"""Detection: scan, time cuts, sliding windows, degrees, components, candidate groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import DAY_US, Detector
from ledgerloom.functions.scalars import from_micros
from ledgerloom.operators.components import window_components
from ledgerloom.storage import written

KEY = ["w", "first_txn"]


def scan(ledger: DataFrame, cfg: Detector) -> DataFrame:
    """Transfers of the formats (all, if none are named) of at least the least amount; a null pattern is 0."""
    out = ledger if cfg.formats is None else ledger.where(F.col("payment_format").isin(*cfg.formats))
    return out.where(F.col("amount") >= cfg.min_amount).withColumn("pattern_id", F.coalesce("pattern_id", F.lit(0)))


def active_end(ledger: DataFrame) -> DataFrame:
    """One row (cut_us): the first day that is quieter than a tenth of the upper median day, else just past the last transfer; null if there is none."""
    day = F.floor(F.col("ts_us") / DAY_US) * DAY_US
    days = ledger.groupBy(day.cast("long").alias("day")).agg(F.count("*").alias("n"), F.max("ts_us").alias("last"))
    facts = days.agg(F.element_at(F.array_sort(F.collect_list("n")), (F.expr("count(*) div 2") + 1).cast("int")).alias("median"), (F.max("last") + 1_000_000).alias("end"))
    quiet = days.join(F.broadcast(facts)).where(10 * F.col("n") < F.col("median")).agg(F.min("day").alias("quiet"))
    return facts.join(F.broadcast(quiet)).select(F.coalesce("quiet", "end").alias("cut_us"))


def trim(ledger: DataFrame) -> DataFrame:
    return ledger.join(F.broadcast(active_end(ledger))).where("ts_us < cut_us").drop("cut_us")


def split_time(ledger: DataFrame, fraction: float) -> DataFrame:
    """One row (cut_us): the first transfer plus the fraction of the span."""
    span = F.max("ts_us") - F.min("ts_us")
    return ledger.agg((F.min("ts_us") + F.round(span * F.lit(fraction)).cast("long")).alias("cut_us"))


def origin_of(ledger: DataFrame) -> DataFrame:
    return ledger.agg(F.min("ts_us").alias("origin"), F.max("ts_us").alias("last"))


def _floor_div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("long")


def assign_windows(ledger: DataFrame, cfg: Detector) -> DataFrame:
    """Every transfer once per window that holds it: (w, window_start, ...). Windows start at the first transfer."""
    t = ledger.join(F.broadcast(origin_of(ledger).select("origin"))).withColumn("since", F.col("ts_us") - F.col("origin"))
    high = _floor_div(F.col("since"), cfg.stride)
    low = F.greatest(F.lit(0).cast("long"), _floor_div(F.col("since") - cfg.width, cfg.stride) + 1)
    t = t.where(high >= low).withColumn("w", F.explode(F.sequence(low, high)))
    return t.withColumn("window_start", F.col("origin") + F.col("w") * cfg.stride).drop("since", "origin")


def window_spine(ledger: DataFrame, cfg: Detector) -> DataFrame:
    """(w, window_start) of every window up to the last transfer."""
    o = origin_of(ledger).where("origin IS NOT NULL")
    return o.withColumn("w", F.explode(F.sequence(F.lit(0).cast("long"), _floor_div(F.col("last") - F.col("origin"), cfg.stride)))).select("w", (F.col("origin") + F.col("w") * cfg.stride).alias("window_start"))


def window_counts(ledger: DataFrame, cfg: Detector) -> DataFrame:
    """(w, window_start, txns) of every window, empty ones included."""
    n = assign_windows(ledger, cfg).groupBy("w").agg(F.count("*").alias("txns"))
    return window_spine(ledger, cfg).join(n, "w", "left").withColumn("txns", F.coalesce("txns", F.lit(0)))


def degrees(windowed: DataFrame) -> DataFrame:
    """(w, acct, degree): both ends count, a self-transfer twice."""
    return windowed.select("w", F.explode(F.array("src", "dst")).alias("acct")).groupBy("w", "acct").agg(F.count("*").alias("degree"))


def without_hubs(windowed: DataFrame, cfg: Detector) -> DataFrame:
    """Without transfers that touch an account of more than the degree allowed in its window."""
    if not cfg.max_degree:
        return windowed
    hubs = degrees(windowed).where(F.col("degree") > cfg.max_degree).select("w", "acct")
    kept = windowed.join(hubs.withColumnRenamed("acct", "src"), ["w", "src"], "left_anti")
    return kept.join(hubs.withColumnRenamed("acct", "dst"), ["w", "dst"], "left_anti")


def groups(windowed: DataFrame, cfg: Detector) -> tuple[DataFrame, DataFrame]:
    """Every transfer of every group of every window, before size limits, (w, component, transfer columns), and the accounts of
    every group, (w, node, component). Both are tables: groups are found once."""
    kept = written(without_hubs(windowed, cfg).select("w", "window_start", "txn_id", "src", "dst"), "windowed")
    labels = written(window_components(kept), "labels")
    return kept.join(labels.withColumnRenamed("node", "src"), ["w", "src"]), labels


def candidates(ledger: DataFrame, cfg: Detector, windowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, members). A candidate is a group within the size limits, once for all windows that hold the same
    transfers, in the earliest; its key is (w, first_txn). Members are its transfers. Candidates are written once, so that
    nothing after them finds components again. ``windowed`` replaces the windows that start at the first transfer."""
    rows, labels = groups(assign_windows(ledger, cfg) if windowed is None else windowed, cfg)
    # Groups are sized before anything is collected, so that what is gathered stays within the limits.
    n = F.col("accounts")
    sizes = labels.groupBy("w", "component").agg(F.count("*").alias("accounts"))
    fits = (F.col("txns") >= cfg.min_txns) & (n >= cfg.min_accounts)
    if cfg.max_txns:
        fits &= F.col("txns") <= cfg.max_txns
    if cfg.max_accounts:
        fits &= n <= cfg.max_accounts
    fit = rows.groupBy("w", "component").agg(F.count("*").alias("txns")).join(sizes, ["w", "component"]).where(fits).select("w", "component")
    each = rows.join(fit, ["w", "component"], "left_semi").groupBy("w", "component").agg(F.first("window_start").alias("window_start"), F.count("*").alias("txns"), F.array_sort(F.collect_list("txn_id")).alias("txn_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("src", "dst"))))).alias("accounts"))
    once = each.groupBy("txn_ids").agg(F.min("w").alias("w"), F.min("window_start").alias("window_start"), F.first("accounts").alias("accounts"), F.first("txns").alias("txns"))
    found = once.withColumn("first_txn", F.element_at("txn_ids", 1))
    found = written(found.select("w", "first_txn", "window_start", "txn_ids", "accounts", "txns"), "candidates")
    bridge = found.select("w", "first_txn", "window_start", F.explode("txn_ids").alias("txn_id"))
    members = bridge.join(ledger.select("txn_id", "ts_us", "src", "dst", F.col("amount").cast("double").alias("amount"), "is_laundering", "pattern_id"), "txn_id")
    return found, members


def shown(us: str) -> Column:
    return from_micros(F.col(us)).alias(us.removesuffix("_us"))
