"""Registered queries over the driver's tables: each applies one analysis to the derived ledger or card table, whole."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.config import HOUR_US, Detector, Limits, Policy
from ledgerloom.functions.scalars import from_micros, micros, sigmoid
from ledgerloom.operators import chain, detect, entity, evaluate, latency, models, policy, registry, rowscorer
from ledgerloom.operators import features as feats
from ledgerloom.sources import derived
from ledgerloom.storage import written

CFG = Detector(formats=("purchase",))
NARROW = Detector(formats=("purchase",), window_hours=24, stride_hours=6)
#: Fixed weights of the published scoring query, by feature of the temporal set; the bias is the last.
WEIGHTS = (0.31, -0.22, 0.17, 0.9, 1.1, 0.12, -0.35, 0.6, 0.011, 0.45, 0.8, 0.7)
BIAS = -2.5
#: Fixed weights over amount, hour and the two ratios of the row scorer's published scoring query.
ROW_WEIGHTS = {"log_amount": 0.4, "hour": 0.03, "sent_ratio": 0.25, "received_ratio": 0.2}
ROW_BIAS = -2.0
BUDGETS = (5, 10, 25, 50, 100)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def big(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


def _ledger(spark: SparkSession, d: str, cfg: Detector = CFG) -> DataFrame:
    return detect.scan(derived.ledger(spark, d), cfg)


_SHARED: dict[tuple, tuple] = {}


def _version(spark: SparkSession, d: str) -> tuple:
    """What tells one state of the events table from another: its files' sizes and times."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = fs.getFileStatus(path)
    held = fs.listStatus(path) if top.isDirectory() else [top]
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in held))


def _found(spark: SparkSession, d: str, cfg: Detector = CFG) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ledger, candidates and members. Queries of a session over the same tables share one detection, kept in the shared folder."""
    key = (spark.sparkContext.applicationId, d, cfg, _version(spark, d))
    if key not in _SHARED:
        ledger = _ledger(spark, d, cfg)
        found, members = detect.candidates(ledger, cfg)
        _SHARED[key] = (ledger, found, written(members, "members"))
    return _SHARED[key]


def fixed_score() -> Column:
    z = F.lit(BIAS)
    for c, w in zip(feats.vector("temporal"), WEIGHTS, strict=True):
        z = z + c * F.lit(w)
    return sigmoid(z)


def _ranked(spark: SparkSession, d: str, cfg: Detector = CFG) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(ledger, candidates, members, ranked by the fixed score with total and accounts)."""
    ledger, found, members = _found(spark, d, cfg)
    scored = feats.features(members).select("w", "first_txn", "total", fixed_score().alias("score"))
    ranked = evaluate.rank(scored.join(found, ["w", "first_txn"]))
    return ledger, found, members, ranked


def _row_scored(spark: SparkSession, d: str) -> DataFrame:
    ledger = _ledger(spark, d)
    cut = detect.split_time(ledger, 0.7)
    both = ledger.join(F.broadcast(cut))
    v = rowscorer.vectors(both.where("ts_us >= cut_us").drop("cut_us"), both.where("ts_us < cut_us").drop("cut_us"))
    z = F.lit(ROW_BIAS)
    for n, w in ROW_WEIGHTS.items():
        z = z + F.col(n) * F.lit(w)
    return v.withColumn("score", F.round(sigmoid(z), 9))


# Scans and cuts


@query
def ledger_scan(spark, d):
    return _ledger(spark, d).select("txn_id", "ts", "src", "dst", F.col("amount").cast("double").alias("amount"), "is_laundering", "pattern_id")


@query
def load_report(spark, d):
    rows = derived.ledger(spark, d)
    return rows.groupBy("payment_format").agg(F.count("*").alias("txns"), F.count(F.when(F.col("is_laundering"), 1)).alias("laundering"), F.count(F.when(F.col("pattern_id") > 0, 1)).alias("labelled"), F.countDistinct("src").alias("senders"), F.min("amount").cast("double").alias("least"), F.max("amount").cast("double").alias("most"))


@query
def typology_report(spark, d):
    return derived.ledger(spark, d).where("pattern_id > 0").groupBy("typology").agg(F.countDistinct("pattern_id").alias("rings"), F.count("*").alias("txns")).orderBy(F.col("txns").desc())


@query
def active_period(spark, d):
    return detect.active_end(_ledger(spark, d)).select(from_micros(F.col("cut_us")).alias("cut"))


def _thinned(spark, d):
    return _ledger(spark, d).where("NOT (dayofmonth(ts) > 25 AND (txn_id - 1) % 20 <> 0)")


@query
def active_period_quiet_tail(spark, d):
    return detect.active_end(_thinned(spark, d)).select(from_micros(F.col("cut_us")).alias("cut"))


@query
def trimmed_ledger(spark, d):
    return detect.trim(_thinned(spark, d)).select("txn_id", "ts")


@query
def split_time(spark, d):
    return detect.split_time(_ledger(spark, d), 0.7).select(from_micros(F.col("cut_us")).alias("cut"))


@query
def window_counts(spark, d):
    return detect.window_counts(_ledger(spark, d), CFG).select("w", from_micros(F.col("window_start")).alias("window_start"), "txns")


@query
def tumbling_window_counts(spark, d):
    cfg = Detector(formats=("purchase",), window_hours=24, stride_hours=24)
    return detect.window_counts(_ledger(spark, d, cfg), cfg).select("w", from_micros(F.col("window_start")).alias("window_start"), "txns")


@query
def window_degree(spark, d):
    return detect.degrees(detect.assign_windows(_ledger(spark, d), CFG)).select("w", "acct", "degree")


@query
def components(spark, d):
    labels = detect.window_components(detect.without_hubs(detect.assign_windows(_ledger(spark, d), CFG), CFG))
    return labels.select("w", "node", "component")


# Candidates and features


def _shown(found: DataFrame) -> DataFrame:
    return found.select("w", "first_txn", from_micros(F.col("window_start")).alias("window_start"), "txns", F.size("accounts").cast("long").alias("accounts"), F.array_join(F.col("txn_ids").cast("array<string>"), ",").alias("txn_ids"))


@query
def candidates(spark, d):
    return _shown(_found(spark, d)[1])


@query
def candidates_hubcap(spark, d):
    return _shown(_found(spark, d, Detector(formats=("purchase",), max_degree=3))[1])


@query
def candidates_sizecap(spark, d):
    return _shown(_found(spark, d, Detector(formats=("purchase",), max_txns=10))[1])


@query
def candidate_accounts(spark, d):
    members = _found(spark, d)[2]
    return feats.accounts_of(members).select("w", "first_txn", "acct", r6("in_amt").alias("in_amt"), r6("out_amt").alias("out_amt"), *big("sends", "recvs"))


@query
def feat_amounts(spark, d):
    f = feats.amounts(_found(spark, d)[2])
    return f.select("w", "first_txn", "txns", *[r6(c).alias(c) for c in ("total", "max_amount", "mean", "span_hours")])


@query
def feat_flow(spark, d):
    f = feats.flows(_found(spark, d)[2])
    return f.select("w", "first_txn", "accounts", "senders", "receivers", r6("pass_through").alias("pass_through"), r6("conservation").alias("conservation"), feats.typology(F.col("accounts"), F.col("senders"), F.col("receivers")).alias("typology"))


@query
def typology_counts(spark, d):
    f = feats.flows(_found(spark, d)[2])
    return f.groupBy(feats.typology(F.col("accounts"), F.col("senders"), F.col("receivers")).alias("typology")).agg(F.count("*").alias("n"))


@query
def feat_burstiness(spark, d):
    return feats.burstiness(_found(spark, d)[2]).select("w", "first_txn", r6("burstiness").alias("burstiness"))


@query
def feat_hour_share(spark, d):
    return feats.max_hour_share(_found(spark, d)[2]).select("w", "first_txn", r6("max_hour_share").alias("max_hour_share"))


@query
def feat_fast_forward(spark, d):
    return feats.fast_forward(_found(spark, d)[2]).select("w", "first_txn", r6("fast_forward").alias("fast_forward"))


@query
def feat_bipartite(spark, d):
    members = _found(spark, d)[2]
    f = feats.amounts(members).join(feats.flows(members), ["w", "first_txn"])
    return f.select("w", "first_txn", *[r6(c).alias(c) for c in ("partition_balance", "pair_reuse", "amount_uniformity")])


@query
def vector_temporal(spark, d):
    f = feats.features(_found(spark, d)[2])
    return f.select("w", "first_txn", *[r6(c).alias(n) for c, n in zip(feats.vector("temporal"), feats.names_for("temporal"), strict=True)])


@query
def candidate_labels(spark, d):
    return evaluate.labels(_found(spark, d)[2]).select("w", "first_txn", "positive")


@query
def candidate_split(spark, d):
    ledger, found, _ = _found(spark, d)
    return evaluate.split(found, detect.split_time(ledger, 0.7)).select("w", "first_txn", "part")


@query
def feature_separation(spark, d):
    members = _found(spark, d)[2]
    f = feats.features(members).join(evaluate.labels(members), ["w", "first_txn"])
    names = ["txns", "accounts", "total", "conservation", "pass_through", "density", "span_hours", "burstiness", "max_hour_share"]
    out = evaluate.separation(f, names)
    return out.select("feature", *[r6(c).alias(c) for c in out.columns if c != "feature"])


# Evaluation and ranking


@query
def eval_unranked(spark, d):
    ledger, _, members = _found(spark, d)
    row = evaluate.evaluate(members, ledger)
    return row.select(*big("rings", "rings_found", "candidates", "true_candidates", "tp", "fp", "fn"), *[r6(c).alias(c) for c in ("fp_value", "precision", "recall", "f1")])


@query
def eval_by_typology(spark, d):
    ledger, _, members = _found(spark, d)
    each = evaluate.rings_found(members, ledger)
    return each.groupBy("typology").agg(F.count("*").alias("rings"), F.count(F.when(F.col("found"), 1)).alias("found"))


@query
def ring_cover(spark, d):
    ledger, _, members = _found(spark, d)
    return evaluate.rings_found(members, ledger).select("pattern_id", "ring_txns", "best", "found")


@query
def score_fixed_weights(spark, d):
    f = feats.features(_found(spark, d)[2])
    return f.select("w", "first_txn", r6(fixed_score()).alias("score"))


@query
def rank_topk(spark, d):
    ranked = _ranked(spark, d)[3]
    return ranked.where(F.col("rank") <= 50).select(*big("rank"), "w", "first_txn", r6("score").alias("score"))


def _budget_columns(out: DataFrame) -> DataFrame:
    return out.select(*big("k", "flagged", "tp", "fp", "fn", "rings_found", "rings"), *[r6(c).alias(c) for c in ("value", "fp_value", "precision", "recall", "f1")])


@query
def eval_ranked_budgets(spark, d):
    ledger, _, members, ranked = _ranked(spark, d)
    return _budget_columns(evaluate.ranked_budgets(ranked, members, ledger, BUDGETS))


def _held_out(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ledger, members, candidates after the cut by rank among themselves)."""
    ledger, _, members, ranked = _ranked(spark, d)
    part = evaluate.split(ranked.drop("rank"), detect.split_time(ledger, 0.7))
    return ledger, members, evaluate.rank(part.where("part = 'test'"))


@query
def eval_heldout_budgets(spark, d):
    """Candidates after the cut alone, against the rings and the laundering that they hold."""
    ledger, members, ranked = _held_out(spark, d)
    return _budget_columns(evaluate.ranked_budgets(ranked, members, ledger, BUDGETS))


@query
def eval_heldout_shapes(spark, d):
    ledger, members, ranked = _held_out(spark, d)
    return evaluate.ranked_shapes(ranked, members, ledger, 25).select("typology", "rings", "rings_found", r6("rate").alias("rate"))


@query
def eval_ranked_shapes(spark, d):
    ledger, _, members, ranked = _ranked(spark, d)
    return evaluate.ranked_shapes(ranked, members, ledger, 100).select("typology", "rings", "rings_found", r6("rate").alias("rate"))


@query
def lift_at_budget(spark, d):
    ledger, _, members, ranked = _ranked(spark, d)
    rate = ledger.agg(evaluate.base_rate(ledger).alias("base_rate"))
    out = evaluate.ranked_budgets(ranked, members, ledger, BUDGETS).join(F.broadcast(rate))
    return out.select(*big("k"), r6("base_rate").alias("base_rate"), r6(F.col("precision") / F.col("base_rate")).alias("lift"))


@query
def score_threshold(spark, d):
    scored = feats.features(_found(spark, d)[2]).select("w", "first_txn", F.round(fixed_score(), 9).alias("score"))
    scored = written(scored, "scored")
    at = evaluate.threshold(scored, 50)
    return scored.agg(F.count(F.when(F.col("score") >= at, 1)).alias("admitted")).withColumn("threshold", F.round(F.lit(float(at)), 6))


# Row scorer


@query
def row_aggregates(spark, d):
    sent, got = rowscorer.aggregates(_ledger(spark, d))
    a = sent.select(F.col("src").alias("account"), F.lit("sent").alias("side"), F.col("sent").alias("txns"), r6("sent_mean").alias("mean"), F.col("out_peers").alias("peers"))
    return a.unionByName(got.select(F.col("dst").alias("account"), F.lit("received").alias("side"), F.col("received").alias("txns"), r6("received_mean").alias("mean"), F.col("in_peers").alias("peers")))


@query
def row_vectors(spark, d):
    v = _row_scored(spark, d)
    return v.select("txn_id", *[r6(n).alias(n) for n in rowscorer.NAMES])


@query
def row_percentiles(spark, d):
    return rowscorer.percentiles(_row_scored(spark, d)).select("txn_id", r6("pct").alias("pct"))


@query
def blindness(spark, d):
    b = rowscorer.blindness(rowscorer.percentiles(_row_scored(spark, d)))
    return b.select("pattern_id", *big("txns", "seen"), r6("best").alias("best"), r6("median").alias("median"))


@query
def compare_equal_budget(spark, d):
    ledger, found, members, ranked = _ranked(spark, d)
    flagged = members.join(ranked.where(F.col("rank") <= 50).select("w", "first_txn"), ["w", "first_txn"])
    return rowscorer.compare(_row_scored(spark, d), flagged, ledger.where("pattern_id > 0").select("pattern_id").distinct()).select("side", *big("flagged", "hits", "rings_found"))


@query
def hero_case(spark, d):
    ledger, _, members, ranked = _ranked(spark, d)
    placed = rowscorer.percentiles(_row_scored(spark, d))
    return rowscorer.heroes(ledger, placed, members, ranked, least=2, limit=3).select("pattern_id", "txns", *big("rank"))


# Policy, leases, replay


def _decided(spark, d, cfg: Detector = CFG) -> tuple[DataFrame, DataFrame]:
    ledger, _, _, ranked = _ranked(spark, d, cfg)
    action, sure = policy.threshold_tier(F.col("score"))
    asked = ranked.withColumns({"proposed": action, "confidence": sure})
    return ledger, policy.apply_policy(asked).withColumns({"imposed_us": F.col("window_start") + cfg.width, "pass_hours": F.lit(cfg.window_hours)})


#: How many alerts each pass of the replays works, and bounds that let the fixed weights block.
WORKED = 60
REPLAYED = Policy(block_score=0.78, block_confidence=0.75)


def _source(spark, d, cfg: Detector, enforces: bool = True) -> policy.Source:
    ranked = _ranked(spark, d, cfg)[3].withColumn("score", F.round("score", 9))
    return policy.Source(cfg.window_hours, cfg.stride_hours, ranked, WORKED, Limits(freeze_hours=cfg.window_hours), enforces)


@query
def policy_apply(spark, d):
    ranked = _ranked(spark, d)[3].withColumn("total", F.col("total") * 2000)
    k = F.col("first_txn") % 4
    asked = ranked.withColumns({"proposed": F.when(k == 0, "allow").when(k == 1, "block").when(k == 2, "hold_for_review").otherwise("escalate"), "confidence": F.when(F.col("first_txn") % 3 == 0, 1.4).otherwise(0.85)})
    out = policy.apply_policy(asked)
    return out.select("w", "first_txn", "proposed", "action", "confidence", F.array_join("adjustments", "; ").alias("adjustments"))


@query
def threshold_decider(spark, d):
    _, decided = _decided(spark, d)
    return decided.groupBy("action").agg(F.count("*").alias("n"))


@query
def rule_decider(spark, d):
    ranked = _ranked(spark, d)[3]
    action, sure = policy.rule_tier(F.col("score"))
    return ranked.select("w", "first_txn", action.alias("proposed"), r6(sure).alias("confidence"))


def _events(spark, d, cfg: Detector = CFG) -> tuple[DataFrame, DataFrame]:
    ledger, decided = _decided(spark, d, cfg)
    rows = decided.select("w", "first_txn", "accounts", "action", "imposed_us", "pass_hours")
    return ledger, policy.leases(rows, Limits(freeze_hours=cfg.window_hours))


@query
def leases(spark, d):
    _, e = _events(spark, d)
    return e.select("w", "first_txn", "account", "tier", from_micros(F.col("imposed_us")).alias("imposed"), from_micros(F.col("expires_us")).alias("expires"))


@query
def register_state(spark, d):
    _, e = _events(spark, d)
    return policy.register(e).select("w", "first_txn", "account", "tier", "outcome")


def _replay_row(row: DataFrame) -> DataFrame:
    counts = ("windows", "decisions", "blocks", "holds", "allows", "declined", "accounts_frozen", "accounts_watch", "unprotected", "checked", "laundering", "stopped", "stopped_laundering", "stopped_clean", "rings_hit", "from_us", "runway_us")
    values = ("unprotected_laundering_value", "value", "laundering_value", "value_stopped", "laundering_value_stopped", "clean_value_stopped", "ceiling_value", "precision", "interception", "of_ceiling")
    return row.select(*big(*counts), *[r6(c).alias(c) for c in values])


@query
def replay_summary(spark, d):
    """The wide pass alone."""
    return _replay_row(policy.replay(_ledger(spark, d), [_source(spark, d, CFG)], p=REPLAYED)[0])


@query
def replay_two_passes(spark, d):
    """Both passes over one register."""
    return _replay_row(policy.replay(_ledger(spark, d), [_source(spark, d, CFG), _source(spark, d, NARROW)], p=REPLAYED)[0])


@query
def replay_narrow_enforces(spark, d):
    """Both passes decide, the narrow one alone leases."""
    return _replay_row(policy.replay(_ledger(spark, d), [_source(spark, d, CFG, False), _source(spark, d, NARROW)], p=REPLAYED)[0])


@query
def replay_by_source(spark, d):
    per = policy.replay(_ledger(spark, d), [_source(spark, d, CFG), _source(spark, d, NARROW)], p=REPLAYED)[1]
    return per.select("pass", *big("pass_hours", "decisions", "blocks", "holds", "allows", "declined", "new", "escalations", "ignored"))


@query
def replay_configurations(spark, d):
    """What every pass buys alone, and both together."""
    sources, recalls = [], []
    for cfg in (CFG, NARROW):
        s = _source(spark, d, cfg)
        ledger, _, members = _found(spark, d, cfg)
        at = evaluate.ranked_budgets(s.ranked, members, ledger, (WORKED,)).groupBy().agg(F.min_by(F.struct("rings_found", "rings", "recall"), "k").alias("b"))
        sources.append(s)
        recalls.append(at.select(F.lit(s.label()).alias("pass"), "b.*"))
    out = policy.combined(_ledger(spark, d), sources, recalls[0].unionByName(recalls[1]), REPLAYED)
    return out.select("configuration", *big("rings_found", "rings", "rings_hit"), *[r6(c).alias(c) for c in ("recall", "laundering_value_stopped", "of_ceiling")])


@query
def lease_lookup(spark, d):
    """The lease in force for every account of a transfer when it is sent, after every account of even length is released on the 480th hour."""
    ledger, e = _events(spark, d)
    start = ledger.agg(F.min("ts_us").alias("origin"))
    lifts = e.select("account").distinct().where("length(account) % 2 = 0").join(F.broadcast(start)).select("account", (F.col("origin") + 480 * HOUR_US).alias("lifted_us"))
    past = policy.history(e, lifts)
    asked = ledger.select(F.col("src").alias("account"), F.col("ts_us").alias("at_us"))
    return policy.lookup(past, asked).select("account", from_micros(F.col("at_us")).alias("sent"), "tier", from_micros(F.col("expires_us")).alias("expires"))


@query
def lease_history(spark, d):
    """Every lease, with when it was lifted, if it was."""
    ledger, e = _events(spark, d)
    start = ledger.agg(F.min("ts_us").alias("origin"))
    lifts = e.select("account").distinct().where("length(account) % 2 = 0").join(F.broadcast(start)).select("account", (F.col("origin") + 480 * HOUR_US).alias("lifted_us"))
    return policy.history(e, lifts).select("w", "first_txn", "account", "tier", from_micros(F.col("lifted_us")).alias("lifted"))


@query
def held_accounts_fold(spark, d):
    _, e = _events(spark, d)
    # Every fifth account is lifted after window 10: events up to there don't count.
    seq = (F.col("w") * 1_000_000 + F.col("first_txn")).alias("seq")
    log = e.select(seq, F.lit("impose").alias("event"), "account", "tier", "imposed_us", "expires_us")
    lifts = e.select("account").distinct().where("length(account) % 2 = 0").select(F.lit(10_000_000).cast("long").alias("seq"), F.lit("lift").alias("event"), "account", F.lit(None).cast("string").alias("tier"), F.lit(None).cast("long").alias("imposed_us"), F.lit(None).cast("long").alias("expires_us"))
    last = _ledger(spark, d).agg(F.max("ts_us")).first()[0]
    return policy.held_accounts(log.unionByName(lifts), last).select("account", "tier", from_micros(F.col("expires_us")).alias("expires"), "expired")


@query
def ceiling(spark, d):
    out = policy.ceiling(_ledger(spark, d), [(72, 24)])
    return _ceiling(out)


@query
def ceiling_sweep(spark, d):
    return _ceiling(policy.ceiling(_ledger(spark, d), [(w, 24) for w in (72, 48, 24, 12, 6)]))


@query
def ceiling_in_span(spark, d):
    return _ceiling(policy.ceiling(_ledger(spark, d), [(72, 24)], span=(240, 480)))


def _ceiling(out: DataFrame) -> DataFrame:
    return out.select(*big("window_hours", "stride_hours", "rings", "never_visible"), r6("total").alias("total"), r6("stoppable").alias("stoppable"), r6("share").alias("share"))


# Registry


def _listed(spark, d) -> DataFrame:
    """A list by rule, so that other engines can make it too: accounts whose name length and ends say so, a day after they are first seen."""
    seen = registry.first_seen(_ledger(spark, d))
    return seen.where("dirty AND seen_us % 3 = 0").select("account", (F.col("seen_us") + 24 * HOUR_US).alias("listed_us"))


@query
def registry_annotate(spark, d):
    _, found, _ = _found(spark, d)
    return registry.annotate(found, _listed(spark, d)).select("w", "first_txn", r6("registry_share").alias("registry_share"))


@query
def amplification(spark, d):
    ledger, _, _, ranked = _ranked(spark, d)
    out = registry.amplification(ranked, ledger, _listed(spark, d), 50)
    return out.select(*big("listed", "reached", "implicated"), r6("ratio").alias("ratio"))


@query
def registry_control_ranking(spark, d):
    ledger, found, members = _found(spark, d)
    ranked = evaluate.rank(registry.annotate(found, _listed(spark, d)), "registry_share")
    out = evaluate.ranked_budgets(ranked, members, ledger, (25, 100))
    return out.select(*big("k", "flagged", "tp", "rings_found"))


@query
def registry_simulated(spark, d):
    return registry.simulate(_ledger(spark, d)).select("account", from_micros(F.col("listed_us")).alias("listed"))


# Fitted models (results depend on the fit; checked by properties)


@query
def ranker_scores(spark, d):
    ledger, found, members = _found(spark, d)
    f = feats.features(members).join(evaluate.labels(members), ["w", "first_txn"]).join(found.select("w", "first_txn", "window_start"), ["w", "first_txn"])
    f = evaluate.split(f, detect.split_time(ledger, 0.7))
    ranker = models.train(f.where("part = 'train'"), feats.vector("temporal"), feats.names_for("temporal"), "positive")
    return f.where("part = 'test'").select("w", "first_txn", r6(ranker.score(feats.vector("temporal"))).alias("score"))


@query
def row_ranker_scores(spark, d):
    """Fitted on the transfers before the cut, over the history of the same time; scores of those after it."""
    both = _ledger(spark, d).join(F.broadcast(detect.split_time(_ledger(spark, d), 0.7)))
    history, pool = both.where("ts_us < cut_us").drop("cut_us"), both.where("ts_us >= cut_us").drop("cut_us")
    columns = [F.col(n) for n in rowscorer.NAMES]
    ranker = models.train(rowscorer.vectors(history, history), columns, rowscorer.NAMES, "is_laundering")
    return rowscorer.vectors(pool, history).select("txn_id", r6(ranker.score(columns)).alias("score"))


@query
def forest_scores(spark, d):
    """Fitted on the candidates before the cut; all are scored."""
    ledger, found, members = _found(spark, d)
    f = feats.features(members).join(found.select("w", "first_txn", "window_start"), ["w", "first_txn"])
    f = evaluate.split(f, detect.split_time(ledger, 0.7))
    return models.anomaly(f, f.where("part = 'train'"), feats.vector("temporal")).select("w", "first_txn", "anomaly")


# Entity resolution




def _resolved(spark, d) -> DataFrame:
    return entity.resolve(derived.cards(spark, d))


@query
def client_resolution(spark, d):
    return _resolved(spark, d).select("transaction_id", "client_key", "client")


@query
def link_groups(spark, d):
    return entity.link_groups(entity.memberships(_resolved(spark, d))).select("rule", "value", "members", "accepted")


@query
def link_pairs(spark, d):
    return entity.link_pairs(entity.memberships(_resolved(spark, d))).select("a", "b", "evidence", "linked")


@query
def entity_rings(spark, d):
    return entity.rings(entity.link_pairs(entity.memberships(_resolved(spark, d))))


@query
def ring_concentration(spark, d):
    r = _resolved(spark, d)
    return entity.concentration(r, entity.rings(entity.link_pairs(entity.memberships(r))))


@query
def ring_size_bands(spark, d):
    return entity.size_bands(entity.rings(entity.link_pairs(entity.memberships(_resolved(spark, d))))).select("band", "rings", *big("clients"))


@query
def ring_evidence(spark, d):
    m = entity.memberships(_resolved(spark, d))
    p = entity.link_pairs(m)
    return entity.evidence(m, p, entity.rings(p)).select("ring", "rule", "value", "members")


@query
def rule_stats(spark, d):
    m = entity.memberships(_resolved(spark, d))
    return entity.rule_stats(m, entity.link_pairs(m)).select("rule", "accepted", "rejected", "used")


# Latency, logs, display


@query
def time_to_decision(spark, d):
    t = latency.decision_times(_ledger(spark, d), CFG)
    return t.select("txn_id", F.col("wait_us").alias("wait_us"), "steady")


@query
def decision_summary(spark, d):
    out = latency.decision_summary(_ledger(spark, d), CFG)
    return out.select("scope", *big("n", "uncovered", "p50", "p95", "p99", "least", "most"), F.round("mean", 3).alias("mean"))


def _event_log(spark, d) -> DataFrame:
    """A well-made chain of one decision an event, over all events."""
    e = spark.read.parquet(f"{d}/events.parquet")
    fields = [F.col("event_id"), micros(F.col("ts")), F.col("user_id"), F.col("event_type"), F.col("value").cast("decimal(20,2)"), F.col("props")]
    return chain.chained(e, "event_id", F.concat_ws("\n", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), chain.GENESIS["decisions"])


@query
def decision_chain(spark, d):
    """The chain over all events, verified whole."""
    return chain.verify_chain(_event_log(spark, d), F.col("body"), chain.GENESIS["decisions"])


@query
def chain_head(spark, d):
    """The hash that commits to all events."""
    return _event_log(spark, d).agg(F.max("seq").alias("entries"), F.max_by("hash", "seq").alias("last_hash"))


@query
def chain_verify(spark, d):
    """The same log, whole and after each kind of change: an entry edited, a link replaced, an entry removed, the first one removed,
    two entries exchanged."""
    log = _event_log(spark, d)
    seq = F.col("seq")
    cases = {
        "whole": log,
        "edited": log.withColumn("body", F.when(seq == 70, F.concat("body", F.lit("!"))).otherwise(F.col("body"))),
        "relinked": log.withColumn("prev_hash", F.when(seq == 40, F.lit("x")).otherwise(F.col("prev_hash"))),
        "removed": log.where("seq <> 55"), "beheaded": log.where("seq <> 1"),
        "exchanged": log.withColumn("seq", F.when(seq == 20, F.lit(21)).when(seq == 21, F.lit(20)).otherwise(seq).cast("long")),
    }
    out = [chain.verify_chain(rows, F.col("body"), chain.GENESIS["decisions"]).select(F.lit(name).alias("change"), "entries", "first_broken") for name, rows in cases.items()]
    return reduce(DataFrame.unionByName, out)


@query
def hub_accounts(spark, d):
    """Accounts on at least half of a candidate's transfers, where it has four or more."""
    members = _found(spark, d)[2]
    n = members.groupBy("w", "first_txn").agg(F.count("*").alias("txns"))
    on = members.select("w", "first_txn", F.explode(F.array_distinct(F.array("src", "dst"))).alias("acct")).groupBy("w", "first_txn", "acct").agg(F.count("*").alias("on"))
    return on.join(n, ["w", "first_txn"]).where("txns >= 4 AND 2 * `on` >= txns").select("w", "first_txn", "acct", F.col("on").alias("touched"))


@query
def net_flow_roles(spark, d):
    a = feats.accounts_of(_found(spark, d)[2])
    role = F.when((F.col("sends") > 0) & (F.col("recvs") > 0), "intermediary").when(F.col("sends") > 0, "source").otherwise("sink")
    return a.select("w", "first_txn", "acct", role.alias("role"), r6(F.col("out_amt") - F.col("in_amt")).alias("net"))


@query
def withheld_truth(spark, d):
    members = _found(spark, d)[2]
    return members.groupBy("w", "first_txn").agg(F.count(F.when(F.col("is_laundering"), 1)).alias("laundering"), F.countDistinct(F.when(F.col("pattern_id") > 0, F.col("pattern_id"))).alias("rings"))


@query
def pattern_link(spark, d):
    """Quoted ring lines matched back to the ledger by their whole tuple; the least id on either side wins."""
    led = _ledger(spark, d)
    quoted = led.where("pattern_id > 0").select(F.col("pattern_id").alias("pattern"), "ts", "src", "dst", "amount")
    per = quoted.join(led.select("txn_id", "ts", "src", "dst", "amount"), ["ts", "src", "dst", "amount"])
    return per.groupBy("txn_id").agg(F.min("pattern").alias("pattern_id"))


