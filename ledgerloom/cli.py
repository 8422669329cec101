"""Command line: ``python -m ledgerloom.cli detect|compare|enforce|report ...`` over AML or derived ledgers."""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.config import Detector, Evaluation, Limits, parse_geometries
from ledgerloom.operators import detect, evaluate, features, models, policy, registry, rowscorer
from ledgerloom.sources import aml, derived


def open_ledger(spark: SparkSession, args) -> DataFrame:
    if args.derived:
        return derived.ledger(spark, args.derived)
    txns = aml.read_transactions(spark, args.transactions)
    if not args.patterns:
        return aml.as_ledger(txns)
    patterns, lines = aml.read_patterns(spark, args.patterns)
    return aml.as_ledger(aml.link_patterns(txns, lines)[0], patterns)


def fit_and_rank(ledger: DataFrame, cfg: Detector, feature_set: str, split: float) -> tuple[DataFrame, DataFrame, DataFrame, models.Ranker]:
    """(ledger, members, ranked test candidates, ranker): detect, fit on candidates before the cut, rank the others."""
    ledger = detect.trim(detect.scan(ledger, cfg))
    found, members = detect.candidates(ledger, cfg)
    rows = features.features(members).join(evaluate.labels(members), ["w", "first_txn"]).join(found.select("w", "first_txn", "window_start", "accounts").withColumnRenamed("accounts", "account_list"), ["w", "first_txn"])
    if feature_set in ("registry", "all"):
        rows = rows.join(registry.annotate(found, registry.simulate(ledger)), ["w", "first_txn"])
    rows = evaluate.split(rows, detect.split_time(ledger, split))
    if feature_set in ("anomaly", "all"):
        rows = models.anomaly(rows, rows.where("part = 'train'"), features.vector("temporal"))
    columns = features.vector(feature_set)
    ranker = models.train(rows.where("part = 'train'"), columns, features.names_for(feature_set), "positive")
    return ledger, members, evaluate.rank(rows.where("part = 'test'").withColumn("score", ranker.score(columns))), ranker


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=("detect", "compare", "enforce", "report"))
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--derived", help="folder of the driver's tables")
    source.add_argument("--transactions", help="AML transactions file")
    p.add_argument("--patterns", help="AML label file")
    p.add_argument("--formats", default="ACH", help="payment formats, comma-separated; empty for all")
    p.add_argument("--geometries", default="72/24")
    p.add_argument("--features", default="temporal", choices=list(features.SETS))
    p.add_argument("--budget", type=int, default=250, help="alerts a pass")
    p.add_argument("--enforcing", default="", help="geometries that may lease, comma-separated; empty for all")
    p.add_argument("--split", type=float, default=0.7)
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("ledgerloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ledger = open_ledger(spark, args)
    formats = tuple(f for f in args.formats.split(",") if f) or None
    if args.command == "report":
        ledger.groupBy("payment_format").agg(F.count("*").alias("txns"), F.count(F.when(F.col("is_laundering"), 1)).alias("laundering")).orderBy(F.col("txns").desc()).show(50, False)
        return
    sources, recalls, cut, scanned = [], [], None, None
    for g in parse_geometries(args.geometries):
        cfg = Detector(formats=formats, window_hours=g.window_hours, stride_hours=g.stride_hours)
        scanned, members, ranked, ranker = fit_and_rank(ledger, cfg, args.features, args.split)
        cut = detect.split_time(scanned, args.split)
        print(f"windows {g.name}: weights {[(n, round(w, 3)) for n, w in ranker.explain()]}")
        if args.command == "detect":
            evaluate.ranked_budgets(ranked, members, scanned, Evaluation().budgets).orderBy("k").show(20, False)
            evaluate.ranked_shapes(ranked, members, scanned, args.budget).show(20, False)
            continue
        if args.command == "compare":
            history, pool = (scanned.join(F.broadcast(cut)).where(c).drop("cut_us") for c in ("ts_us < cut_us", "ts_us >= cut_us"))
            columns = [F.col(n) for n in rowscorer.NAMES]
            row = models.train(rowscorer.vectors(history, history), columns, rowscorer.NAMES, "is_laundering")
            rows = rowscorer.vectors(pool, history).withColumn("score", row.score(columns))
            flagged = members.join(ranked.where(F.col("rank") <= args.budget).select("w", "first_txn"), ["w", "first_txn"])
            rowscorer.compare(rows, flagged, pool.where("pattern_id > 0").select("pattern_id").distinct()).show(2, False)
            rowscorer.blindness(rowscorer.percentiles(rows)).orderBy(F.col("best").desc()).show(20, False)
            continue
        s = policy.Source(g.window_hours, g.stride_hours, ranked.drop("accounts").withColumnRenamed("account_list", "accounts"), args.budget, Limits(freeze_hours=g.window_hours), not args.enforcing or g.name in args.enforcing.split(","))
        sources.append(s)
        at = evaluate.ranked_budgets(ranked, members, scanned, (args.budget,)).groupBy().agg(F.min_by(F.struct("rings_found", "rings", "recall"), "k").alias("b"))
        recalls.append(at.select(F.lit(s.label()).alias("pass"), "b.*"))
    if sources:
        late = scanned.join(F.broadcast(cut)).where("ts_us >= cut_us").drop("cut_us")
        row, per = policy.replay(late, sources)
        row.show(1, False, True)
        per.show(20, False)
        policy.combined(late, sources, reduce(DataFrame.unionByName, recalls)).show(20, False)
        policy.ceiling(late, [(w, min(24, w)) for w in (72, 48, 24, 12, 6)]).show(5, False)


if __name__ == "__main__":
    main()
