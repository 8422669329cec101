"""Suspect lists: simulated, annotated, and how far listed accounts reach into alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import HOUR_US, RegistrySpec
from ledgerloom.functions.scalars import share

KEY = ["w", "first_txn"]


def _uniform(account: Column, seed: int, draw: int) -> Column:
    """A number in (0, 1) that depends on account, seed and draw alone: ten hexadecimal digits of a digest."""
    digits = F.substring(F.md5(F.concat_ws(":", account, F.lit(str(seed)), F.lit(str(draw)))), 1, 10)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 40)


def first_seen(ledger: DataFrame) -> DataFrame:
    """(account, seen_us, dirty) of every end of a transfer; dirty if any of its transfers is laundering."""
    ends = ledger.select("ts_us", "is_laundering", F.explode(F.array("src", "dst")).alias("account"))
    return ends.groupBy("account").agg(F.min("ts_us").alias("seen_us"), F.max("is_laundering").alias("dirty"))


def simulate(ledger: DataFrame, spec: RegistrySpec = RegistrySpec()) -> DataFrame:
    """(account, listed_us): launderers with the coverage's chance, listed after an exponential delay, plus false reports.

    Draws hash the account, so the list doesn't depend on row order; false reports are the clean accounts of smallest draw.
    """
    seen = first_seen(ledger)
    delay = (-F.log(_uniform(F.col("account"), spec.seed, 1)) * spec.delay_hours * HOUR_US).cast("long")
    when = F.col("seen_us") + delay
    true = seen.where("dirty").where(_uniform(F.col("account"), spec.seed, 0) < spec.coverage).select("account", when.alias("listed_us"))
    n = true.count()
    false = int(n * spec.false_rate / (1 - spec.false_rate)) if spec.false_rate < 1 else 0
    wrong = seen.where("NOT dirty").orderBy(_uniform(F.col("account"), spec.seed, 2), "account").limit(false).select("account", when.alias("listed_us"))
    return true.unionByName(wrong)


def annotate(found: DataFrame, listed: DataFrame | None) -> DataFrame:
    """(w, first_txn, registry_share): the share of a candidate's accounts that are listed when its window starts."""
    if listed is None:
        return found.select(*KEY, F.lit(0.0).alias("registry_share"))
    each = found.select(*KEY, "window_start", F.explode("accounts").alias("account")).join(listed, "account", "left")
    hit = F.coalesce((F.col("listed_us") <= F.col("window_start")).cast("double"), F.lit(0.0))
    return each.groupBy(*KEY).agg(F.avg(hit).alias("registry_share"))


def amplification(ranked: DataFrame, ledger: DataFrame, listed: DataFrame, budget: int) -> DataFrame:
    """One row: listed accounts that any ranked candidate holds, alerts within the budget that hold one listed by the start of
    their window, further laundering accounts in those alerts, and their ratio."""
    held = ranked.select(*KEY, "window_start", "rank", F.explode("accounts").alias("account"))
    on_list = listed.join(held.select("account").distinct(), "account", "left_semi")
    alerts = held.where(F.col("rank") <= budget)
    reached = alerts.join(listed, "account").where("listed_us <= window_start").select(*KEY).distinct()
    dirty = first_seen(ledger).where("dirty")
    implicated = alerts.join(reached, KEY, "left_semi").join(dirty, "account", "left_semi").join(on_list, "account", "left_anti").select("account").distinct()
    row = on_list.agg(F.countDistinct("account").alias("listed")).join(F.broadcast(reached.agg(F.count("*").alias("reached")))).join(F.broadcast(implicated.agg(F.count("*").alias("implicated"))))
    return row.withColumn("ratio", share(F.col("implicated"), F.col("listed")))
