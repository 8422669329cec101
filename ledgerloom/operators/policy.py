"""Bounded decisions: proposals, gates, leases of account restrictions and their replay."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.config import DAY_US, HOUR_US, Limits, Policy
from ledgerloom.functions.scalars import clamp01, next_closure, share
from ledgerloom.operators.evaluate import threshold
from ledgerloom.storage import written

KEY = ["w", "first_txn"]
ACTIONS = ("allow", "hold_for_review", "block")


def severity(action: Column) -> Column:
    return F.when(action == "allow", 0).when(action == "hold_for_review", 1).when(action == "block", 2).otherwise(-1)


def rule_tier(score: Column, p: Policy = Policy()) -> tuple[Column, Column]:
    """Proposal and confidence of the rule that never blocks."""
    return F.when(score >= p.hold_score, "hold_for_review").otherwise("allow"), F.when(score >= p.hold_score, score).otherwise(1 - score)


def threshold_tier(score: Column, p: Policy = Policy()) -> tuple[Column, Column]:
    """Proposal of the decider used to measure replays."""
    action = F.when(score >= p.block_score, "block").when(score >= p.hold_score, "hold_for_review").otherwise("allow")
    return action, F.when(score >= p.hold_score, score).otherwise(1 - score)


def apply_policy(rows: DataFrame, p: Policy = Policy()) -> DataFrame:
    """(…, action, proposed, confidence, adjustments) from (score, total, proposed, confidence); the first failing gate is recorded."""
    known = severity(F.col("proposed")) >= 0
    asked = F.when(known, F.col("proposed")).otherwise("hold_for_review")
    sure = clamp01(F.col("confidence"))
    reason = F.when(F.col("score") < p.block_score, "score below the block bound").when(sure < p.block_confidence, "confidence below the block bound").when(F.col("total") > p.block_amount, "amount above the block bound")
    blocked = asked == "block"
    eased = (asked == "allow") & (F.col("score") >= p.hold_score)
    action = F.when(blocked & reason.isNotNull(), "hold_for_review").when(eased, "hold_for_review").otherwise(asked)
    notes = F.array_compact(F.array(F.when(~known, F.concat(F.lit("unknown action: "), F.coalesce(F.col("proposed"), F.lit("null")))), F.when(sure != F.col("confidence"), "confidence clamped"), F.when(blocked & reason.isNotNull(), F.concat(F.lit("block withheld: "), reason)), F.when(eased, "allow withheld: score at the hold bound")))
    return rows.select(*[c for c in rows.columns if c not in ("proposed", "confidence")], asked.alias("proposed"), sure.alias("confidence"), action.alias("action"), notes.alias("adjustments"))


def leases(decided: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(account, tier, imposed_us, expires_us, keys of the decision): a block freezes, a hold watches; a block of too many accounts leases nothing."""
    tier = F.when(F.col("action") == "block", "frozen").when(F.col("action") == "hold_for_review", "watch")
    hours = F.when(F.col("action") == "block", F.col("freeze_hours") if "freeze_hours" in decided.columns else F.lit(limits.freeze_hours)).otherwise(limits.watch_hours)
    bound = (F.col("action") == "block") & (F.size("accounts") > limits.max_accounts)
    rest = [c for c in decided.columns if c not in ("accounts", "action", "freeze_hours")]
    rows = decided.where(tier.isNotNull() & ~bound).withColumns({"tier": tier, "expires_us": F.col("imposed_us") + hours.cast("long") * HOUR_US})
    return rows.select(*rest, "tier", "expires_us", F.explode("accounts").alias("account"))


def register(events: DataFrame) -> DataFrame:
    """The leases with ``outcome`` new, extended or ignored, in the order (imposed_us, pass_hours, w, first_txn) of each account.

    A watch never displaces a freeze, a freeze displaces a watch, the later expiry of a tier wins; lapsed leases still count.
    """
    order = Window.partitionBy("account").orderBy("imposed_us", "pass_hours", *KEY)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    frozen = F.max(F.when(F.col("tier") == "frozen", F.col("expires_us"))).over(before)
    watched = F.max(F.when(F.col("tier") == "watch", F.col("expires_us"))).over(before)
    first = F.row_number().over(order) == 1
    up = F.when(F.col("tier") == "frozen", frozen.isNull() | (F.col("expires_us") > frozen)).otherwise(frozen.isNull() & (F.col("expires_us") > watched))
    return events.withColumn("outcome", F.when(first, "new").when(F.coalesce(up, F.lit(False)), "extended").otherwise("ignored"))


def stopped(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """Transfers with ``stopped``: their sender is frozen when they are made. Leases of an instant come before its transfers.

    Leases and transfers meet by account and day, so a busy account's history is spread over tasks.
    """
    day = lambda us: F.floor(us / F.lit(DAY_US)).cast("long")
    e = events.where("tier = 'frozen' AND expires_us > imposed_us").groupBy(F.col("account").alias("src"), "imposed_us").agg(F.max("expires_us").alias("until"))
    e = e.withColumn("__day", F.explode(F.sequence(day(F.col("imposed_us")), day(F.col("until") - 1))))
    t = ledger.select("txn_id", "src", "ts_us", day(F.col("ts_us")).alias("__day"))
    hit = t.join(e, ["src", "__day"]).where("ts_us >= imposed_us AND ts_us < until").select("txn_id").distinct().withColumn("hit", F.lit(True))
    return ledger.join(hit, "txn_id", "left").withColumn("stopped", F.coalesce("hit", F.lit(False))).drop("hit")


@dataclass(frozen=True)
class Source:
    """A detection pass that feeds the register: its geometry, its ranked candidates (w, first_txn, window_start, accounts, score,
    total), how many of them are worked, the limits of its leases, and whether it may lease at all."""

    window_hours: int
    stride_hours: int
    ranked: DataFrame
    budget: int
    limits: Limits = Limits()
    enforces: bool = True
    name: str = ""

    def label(self) -> str:
        return self.name or f"{self.window_hours}h/{self.stride_hours}h"


def decide(sources: list[Source], decider: Callable[[Column], tuple[Column, Column]] | None = None, p: Policy = Policy()) -> tuple[DataFrame, DataFrame]:
    """(decisions, closures) of all passes. A decision is taken for every candidate that reaches its pass's budget threshold, at
    the close of its window; closures are those of all windows that raised a candidate, (pass, at_us)."""
    decisions, closures = [], []
    for k, s in enumerate(sources):
        at = F.col("window_start") + F.lit(s.window_hours * HOUR_US)
        keys = {"pass": F.lit(s.label()), "pass_no": F.lit(k), "pass_hours": F.lit(s.window_hours), "enforces": F.lit(s.enforces)}
        closures.append(s.ranked.select(at.alias("at_us"), keys["pass"].alias("pass")).distinct())
        action, sure = decider(F.col("score")) if decider else threshold_tier(F.col("score"), p)
        worked = s.ranked.where(F.col("score") >= threshold(s.ranked, s.budget)).withColumns({"proposed": action, "confidence": sure})
        made = apply_policy(worked, p).withColumns(keys | {"imposed_us": at, "freeze_hours": F.lit(s.limits.freeze_hours), "watch_hours": F.lit(s.limits.watch_hours)})
        large = F.col("enforces") & (F.col("action") == "block") & (F.size("accounts") > s.limits.max_accounts)
        reason = F.format_string("declined to freeze: %d accounts, more than the %d of one automated action", F.size("accounts"), F.lit(s.limits.max_accounts))
        decisions.append(made.withColumns({"declined": large, "bound": F.when(large, reason)}))
    return reduce(DataFrame.unionByName, decisions), reduce(DataFrame.unionByName, closures)


def imposed(decisions: DataFrame) -> DataFrame:
    """The leases that the decisions of enforcing passes authorise, a row an account, with what the register made of them."""
    tier = F.when(F.col("action") == "block", "frozen").when(F.col("action") == "hold_for_review", "watch")
    hours = F.when(F.col("action") == "block", F.col("freeze_hours")).otherwise(F.col("watch_hours"))
    rows = decisions.where(F.col("enforces") & tier.isNotNull() & ~F.col("declined")).withColumns({"tier": tier, "expires_us": F.col("imposed_us") + hours.cast("long") * HOUR_US})
    return register(rows.select(*KEY, "pass", "pass_no", "pass_hours", "tier", "imposed_us", "expires_us", F.explode("accounts").alias("account")))


def replay(ledger: DataFrame, sources: list[Source], decider: Callable[[Column], tuple[Column, Column]] | None = None, p: Policy = Policy(), min_txns: int = 3) -> tuple[DataFrame, DataFrame]:
    """(summary, by pass) of all passes over one register, against the ledger.

    The enforceable period starts at the first closure of a window that raised a candidate; what is sent before it is
    unprotected. Only a freeze of the sender stops a transfer. Precision is the laundering share of the stopped value,
    interception the stopped share of the laundering value of the period, and of_ceiling the share of what a detector that
    knew every ring could have stopped in it at the narrowest enforcing geometry.
    """
    decisions, closures = decide(sources, decider, p)
    decisions, closures = written(decisions, "decisions"), written(closures, "closures")
    leased = written(imposed(decisions), "leases")
    span = closures.agg(F.min("at_us").alias("from_us"), F.count("*").alias("windows"))
    t = stopped(ledger, leased).join(F.broadcast(span))
    late, dirty = F.col("ts_us") >= F.col("from_us"), F.col("is_laundering")
    hit = late & F.col("stopped")
    count = lambda c: F.count(F.when(c, 1))
    value = lambda c: F.coalesce(F.sum(F.when(c, F.col("amount").cast("double"))), F.lit(0.0))
    flows = t.agg(
        F.max("from_us").alias("from_us"), F.max("windows").alias("windows"), F.max("ts_us").alias("to_us"),
        count(~late).alias("unprotected"), value(~late & dirty).alias("unprotected_laundering_value"),
        count(late).alias("checked"), count(late & dirty).alias("laundering"), value(late).alias("value"), value(late & dirty).alias("laundering_value"),
        count(hit).alias("stopped"), count(hit & dirty).alias("stopped_laundering"), count(hit & ~dirty).alias("stopped_clean"),
        value(hit).alias("value_stopped"), value(hit & dirty).alias("laundering_value_stopped"), value(hit & ~dirty).alias("clean_value_stopped"),
        F.countDistinct(F.when(hit & dirty & (F.col("pattern_id") > 0), F.col("pattern_id"))).alias("rings_hit"),
    )
    action = F.col("action")
    counts = [F.count("*").alias("decisions"), count(action == "block").alias("blocks"), count(action == "hold_for_review").alias("holds"), count(action == "allow").alias("allows"), count(F.col("declined")).alias("declined")]
    accounts = leased.agg(*[F.countDistinct(F.when(F.col("tier") == x, F.col("account"))).alias(f"accounts_{x}") for x in ("frozen", "watch")])
    fastest = min((s for s in sources if s.enforces), key=lambda s: s.window_hours, default=sources[0])
    top = ceiling(ledger, [(fastest.window_hours, fastest.stride_hours)], min_txns, start=span.select(F.col("from_us").alias("start_us"))).select(F.col("stoppable").alias("ceiling_value"))
    row = flows.join(F.broadcast(decisions.agg(*counts))).join(F.broadcast(accounts)).join(F.broadcast(top), how="left").withColumn("ceiling_value", F.coalesce("ceiling_value", F.lit(0.0)))
    row = row.withColumns({
        "runway_us": F.col("to_us") - F.col("from_us"), "precision": share(F.col("laundering_value_stopped"), F.col("value_stopped")),
        "interception": share(F.col("laundering_value_stopped"), F.col("laundering_value")), "of_ceiling": share(F.col("laundering_value_stopped"), F.col("ceiling_value")),
    })
    made = leased.groupBy("pass_no").agg(count(F.col("outcome") == "new").alias("new"), count(F.col("outcome") == "extended").alias("escalations"), count(F.col("outcome") == "ignored").alias("ignored"))
    per = decisions.groupBy("pass", "pass_no", "pass_hours").agg(*counts).join(made, "pass_no", "left").na.fill(0, ["new", "escalations", "ignored"])
    return row, per.drop("pass_no")


def combined(ledger: DataFrame, sources: list[Source], recalls: DataFrame, p: Policy = Policy()) -> DataFrame:
    """(configuration, rings_found, rings, recall, rings_hit, laundering_value_stopped, of_ceiling): every pass alone and all over
    one register. ``recalls`` has (pass, rings_found, rings, recall) at the passes' budgets; all together see what the pass
    of the highest recall sees."""
    shown = ("rings_hit", "laundering_value_stopped", "of_ceiling")
    alone = reduce(DataFrame.unionByName, [replay(ledger, [replace(s, enforces=True)], p=p)[0].select(F.lit(s.label()).alias("pass"), *shown) for s in sources])
    each = alone.join(recalls, "pass").select(F.concat("pass", F.lit(" alone")).alias("configuration"), "rings_found", "rings", "recall", *shown)
    if len(sources) < 2:
        return each
    best = recalls.agg(F.max_by(F.struct("rings_found", "rings", "recall"), F.struct("recall", "pass")).alias("b")).select("b.*")
    return each.unionByName(replay(ledger, sources, p=p)[0].select(F.lit("together").alias("configuration"), *shown).join(F.broadcast(best)).select(*each.columns))


def ceiling(ledger: DataFrame, geometries: list[tuple[int, int]], min_txns: int = 3, span: tuple[int, int] | None = None, start: DataFrame | None = None) -> DataFrame:
    """Per geometry: what a detector that knew every ring could stop, from the first closure after a ring's ``min_txns``-th transfer.

    ``span``, in hours from the first transfer, and ``start``, one row (start_us), limit which transfers are counted, not
    which make a ring visible.
    """
    origin = ledger.agg(F.min("ts_us").alias("origin")).join(F.broadcast(ledger.sparkSession.range(1).select(F.lit(None).cast("long").alias("start_us")) if start is None else start))
    ring = ledger.where("pattern_id > 0 AND is_laundering").select("pattern_id", "txn_id", "ts_us", F.col("amount").cast("double").alias("amount"))
    nth = ring.withColumn("n", F.row_number().over(Window.partitionBy("pattern_id").orderBy("ts_us", "txn_id"))).where(F.col("n") == min_txns).select("pattern_id", F.col("ts_us").alias("visible"))
    rows = ring.join(nth, "pattern_id", "left").join(F.broadcast(origin))
    cases = [F.struct(F.lit(w).alias("window_hours"), F.lit(s).alias("stride_hours"), next_closure(F.col("origin"), F.col("visible"), w * HOUR_US, min(s, w) * HOUR_US).alias("closure")) for w, s in geometries]
    rows = rows.select("*", F.explode(F.array(*cases)).alias("g")).select("pattern_id", "ts_us", "amount", "visible", "origin", "start_us", "g.*")
    begun = F.coalesce(F.col("ts_us") >= F.col("start_us"), F.lit(True))
    counted = begun if span is None else begun & (F.col("ts_us") >= F.col("origin") + span[0] * HOUR_US) & (F.col("ts_us") < F.col("origin") + span[1] * HOUR_US)
    reach = counted & F.col("visible").isNotNull() & (F.col("ts_us") >= F.col("closure"))  # a ring that no window sees has no closure
    out = rows.groupBy("window_hours", "stride_hours").agg(
        F.countDistinct("pattern_id").alias("rings"), F.countDistinct(F.when(F.col("visible").isNull(), F.col("pattern_id"))).alias("never_visible"),
        F.coalesce(F.sum(F.when(counted, F.col("amount"))), F.lit(0.0)).alias("total"), F.coalesce(F.sum(F.when(reach, F.col("amount"))), F.lit(0.0)).alias("stoppable"),
    )
    return out.withColumn("share", share(F.col("stoppable"), F.col("total")))


def held_accounts(log: DataFrame, at_us: int | None = None) -> DataFrame:
    """(account, tier, imposed_us, expires_us, expired), from a log (seq, event, account, tier, imposed_us, expires_us).

    Only events after an account's last lift count; of those the register's rules keep one: a freeze before a watch, then the
    later expiry, then the earlier event. ``expired`` says whether it is out of force at ``at_us`` (null without one).
    """
    lift = log.where("event = 'lift'").groupBy("account").agg(F.max("seq").alias("lifted_seq"))
    live = log.where("event = 'impose'").join(lift, "account", "left").where("lifted_seq IS NULL OR seq > lifted_seq")
    order = F.struct((F.col("tier") == "frozen").cast("int"), F.col("expires_us"), -F.col("seq"))
    kept = live.groupBy("account").agg(F.max_by(F.struct("tier", "imposed_us", "expires_us"), order).alias("k")).select("account", "k.*")
    active = (F.col("imposed_us") <= F.lit(at_us)) & (F.lit(at_us) < F.col("expires_us"))
    return kept.withColumn("expired", F.lit(None).cast("boolean") if at_us is None else ~active)


def history(leases: DataFrame, lifts: DataFrame) -> DataFrame:
    """Every lease with ``lifted_us``: the first lift (account, lifted_us) of its account while it is in force, null if it ran out."""
    held = leases.withColumn("__id", F.monotonically_increasing_id())
    met = held.select("__id", "account", "imposed_us", "expires_us").join(lifts, "account").where("lifted_us >= imposed_us AND lifted_us < expires_us")
    return held.join(met.groupBy("__id").agg(F.min("lifted_us").alias("lifted_us")), "__id", "left").drop("__id")


def lookup(leases: DataFrame, asked: DataFrame, stops: bool = False) -> DataFrame:
    """(account, at_us, tier, imposed_us, expires_us) of the lease in force for every (account, at_us) that has one: a freeze
    before a watch, then the later expiry; with ``stops``, freezes alone. Leases may carry ``lifted_us``."""
    end = F.least("expires_us", "lifted_us") if "lifted_us" in leases.columns else F.col("expires_us")
    met = asked.select("account", "at_us").distinct().join(leases.select("account", "tier", "imposed_us", "expires_us", end.alias("__end")), "account")
    met = met.where("imposed_us <= at_us AND at_us < __end")
    met = met.where("tier = 'frozen'") if stops else met
    order = F.struct((F.col("tier") == "frozen").cast("int"), F.col("expires_us"), F.col("imposed_us"))
    return met.groupBy("account", "at_us").agg(F.max_by(F.struct("tier", "imposed_us", "expires_us"), order).alias("k")).select("account", "at_us", "k.*")


def active_at(leases: DataFrame, at_us: int) -> DataFrame:
    """The lease in force of every account that has one at an instant."""
    return lookup(leases, leases.select("account", F.lit(at_us).alias("at_us")))
