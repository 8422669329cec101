"""Ranking, labels and evaluation of candidates against labelled rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.config import Evaluation
from ledgerloom.functions.scalars import f1, share
from ledgerloom.storage import written

KEY = ["w", "first_txn"]


def labels(members: DataFrame) -> DataFrame:
    """(w, first_txn, positive): whether a candidate touches any ring."""
    return members.groupBy(*KEY).agg(F.max(F.col("pattern_id") != 0).alias("positive"))


def split(found: DataFrame, cut: DataFrame) -> DataFrame:
    """Candidates with ``part``: train where the window starts before the cut, else test."""
    return found.join(F.broadcast(cut)).withColumn("part", F.when(F.col("window_start") < F.col("cut_us"), "train").otherwise("test")).drop("cut_us")


def rank(scored: DataFrame, score: str = "score") -> DataFrame:
    """``rank`` from 1 by score, ties by position (window, first transfer).

    Ranks come from a range-partitioned sort: rows are ranked inside their range and shifted by the counts of the ranges
    before it, so no task sees all rows.
    """
    spark = scored.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(score).desc(), *map(F.col, KEY)]
    placed = scored.repartitionByRange(n, *order).withColumn("__p", F.spark_partition_id())
    placed = written(placed, "ranked")
    before = placed.groupBy("__p").agg(F.count("*").alias("m")).withColumn("__off", F.coalesce(F.sum("m").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = placed.withColumn("__r", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    return within.join(F.broadcast(before.select("__p", "__off")), "__p").withColumn("rank", F.col("__r") + F.col("__off")).drop("__p", "__r", "__off")


def running(rows: DataFrame, groups: list[str], order: str, size: str) -> DataFrame:
    """The rows with ``before``: the sum of ``size`` over the rows of their group that come earlier by ``order``.

    Rows are sorted into ranges, summed inside each, and shifted by the sums of the ranges before; groups with rows in a
    range number one row each there.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(rows.repartitionByRange(parts, *groups, order).withColumn("__p", F.spark_partition_id()), "running")
    upto = lambda by, on: Window.partitionBy(*by).orderBy(on).rowsBetween(Window.unboundedPreceding, -1)
    ahead = placed.groupBy(*groups, "__p").agg(F.sum(size).alias("__m")).withColumn("__off", F.coalesce(F.sum("__m").over(upto(groups, "__p")), F.lit(0))).drop("__m")
    within = placed.withColumn("__r", F.coalesce(F.sum(size).over(upto([*groups, "__p"], order)), F.lit(0)))
    return within.join(F.broadcast(ahead), [*groups, "__p"]).withColumn("before", F.col("__r") + F.col("__off")).drop("__p", "__r", "__off")


def threshold(scored: DataFrame, n: int, score: str = "score") -> float:
    """The n-th largest score; 0 where n is not positive or reaches the number of rows."""
    total = scored.count()
    if n <= 0 or n >= total:
        return 0.0
    return scored.orderBy(F.col(score).desc()).limit(n).agg(F.min(score)).first()[0]


def ring_sizes(ledger: DataFrame) -> DataFrame:
    return ledger.where("pattern_id > 0").groupBy("pattern_id").agg(F.count("*").alias("ring_txns"), F.first("typology").alias("typology"))


def _overlap(members: DataFrame) -> DataFrame:
    return members.where("pattern_id > 0").groupBy(*KEY, "pattern_id").agg(F.count("*").alias("hit"))


def rings_found(members: DataFrame, ledger: DataFrame, cfg: Evaluation = Evaluation()) -> DataFrame:
    """(pattern_id, typology, ring_txns, best, found): found if one candidate holds the cover of it."""
    best = _overlap(members).groupBy("pattern_id").agg(F.max("hit").alias("best"))
    return ring_sizes(ledger).join(best, "pattern_id", "left").withColumn("best", F.coalesce("best", F.lit(0))).withColumn("found", F.col("best") >= cfg.cover * F.col("ring_txns"))


def evaluate(members: DataFrame, ledger: DataFrame, cfg: Evaluation = Evaluation()) -> DataFrame:
    """One row: rings, candidates and transfers, unranked."""
    rings = rings_found(members, ledger, cfg).agg(F.count("*").alias("rings"), F.count(F.when(F.col("found"), 1)).alias("rings_found"))
    sizes = members.groupBy(*KEY).agg(F.count("*").alias("txns"))
    purest = _overlap(members).groupBy(*KEY).agg(F.max("hit").alias("hit"))
    true = sizes.join(purest, KEY, "left").agg(F.count("*").alias("candidates"), F.count(F.when(F.col("hit") >= cfg.purity * F.col("txns"), 1)).alias("true_candidates"))
    flagged = members.select("txn_id", "is_laundering", "amount").dropDuplicates(["txn_id"])
    hit = flagged.agg(F.count(F.when(F.col("is_laundering"), 1)).alias("tp"), F.count(F.when(~F.col("is_laundering"), 1)).alias("fp"), F.coalesce(F.sum(F.when(~F.col("is_laundering"), F.col("amount"))), F.lit(0.0)).alias("fp_value"))
    total = ledger.agg(F.count(F.when(F.col("is_laundering"), 1)).alias("laundering"))
    row = rings.join(F.broadcast(true)).join(F.broadcast(hit)).join(F.broadcast(total)).withColumn("fn", F.col("laundering") - F.col("tp"))
    p, r = share(F.col("tp"), F.col("tp") + F.col("fp")), share(F.col("tp"), F.col("laundering"))
    return row.withColumns({"precision": p, "recall": r, "f1": f1(p, r)}).drop("laundering")


def in_candidates(ranked: DataFrame, members: DataFrame) -> DataFrame:
    """The transfers of the ranked candidates, each once with the best rank of those that hold it: the ground truth of a ranking
    is theirs alone, so that a held-out ranking is judged on the held-out part."""
    held = members.join(ranked.select(*KEY, "rank"), KEY)
    first = [F.first(c).alias(c) for c in ("is_laundering", "pattern_id", "amount")]
    return held.groupBy("txn_id").agg(F.min("rank").alias("rank"), *first)


def _reached(rows: DataFrame, budgets: tuple[int, ...], n: DataFrame) -> DataFrame:
    """The rows once for every budget that reaches their rank, as ``k``; a budget is cut to the number of candidates, which is one itself."""
    asked = F.array_distinct(F.array(*[F.least(F.lit(b).cast("long"), F.col("__n")) for b in budgets], F.col("__n")))
    return rows.join(F.broadcast(n)).withColumn("k", F.explode(F.filter(asked, lambda k: k >= F.col("rank")))).drop("__n")


def ranked_budgets(ranked: DataFrame, members: DataFrame, ledger: DataFrame, budgets: tuple[int, ...], cfg: Evaluation = Evaluation()) -> DataFrame:
    """Per budget: alerts, distinct transfers flagged, hits, rings found, against the transfers of the ranked candidates. A ring's
    hits count every occurrence in the flagged candidates; its size counts its transfers that any ranked candidate holds."""
    n = ranked.agg(F.count("*").alias("__n"))
    best = in_candidates(ranked, members)
    flag = _reached(best, budgets, n)
    clean = ~F.col("is_laundering")
    per = flag.groupBy("k").agg(F.count("*").alias("flagged"), F.count(F.when(F.col("is_laundering"), 1)).alias("tp"), F.sum("amount").alias("value"), F.coalesce(F.sum(F.when(clean, F.col("amount"))), F.lit(0.0)).alias("fp_value"))
    sizes = best.where("pattern_id > 0").groupBy("pattern_id").agg(F.count("*").alias("ring_txns"))
    seen = members.where("pattern_id > 0").join(ranked.select(*KEY, "rank"), KEY)
    hits = _reached(seen, budgets, n).groupBy("k", "pattern_id").agg(F.count("*").alias("hits"))
    found = hits.join(sizes, "pattern_id").where(F.col("hits") >= cfg.cover * F.col("ring_txns")).groupBy("k").agg(F.count("*").alias("rings_found"))
    total = best.agg(F.count(F.when(F.col("is_laundering"), 1)).alias("laundering"), F.countDistinct(F.when(F.col("pattern_id") > 0, F.col("pattern_id"))).alias("rings"))
    out = per.join(found, "k", "left").join(F.broadcast(total)).withColumn("rings_found", F.coalesce("rings_found", F.lit(0)))
    out = out.withColumns({"fp": F.col("flagged") - F.col("tp"), "fn": F.col("laundering") - F.col("tp"), "precision": share(F.col("tp"), F.col("flagged")), "recall": share(F.col("tp"), F.col("laundering"))})
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def ranked_shapes(ranked: DataFrame, members: DataFrame, ledger: DataFrame, budget: int, cfg: Evaluation = Evaluation()) -> DataFrame:
    """(typology, rings, rings_found, rate) at a budget, by rate then name, of the rings that the ranked candidates touch."""
    sizes = in_candidates(ranked, members).where("pattern_id > 0").groupBy("pattern_id").agg(F.count("*").alias("ring_txns"))
    names = ledger.where("pattern_id > 0").groupBy("pattern_id").agg(F.first("typology").alias("typology"))
    hits = members.join(ranked.where(F.col("rank") <= budget).select(*KEY), KEY).where("pattern_id > 0").groupBy("pattern_id").agg(F.count("*").alias("hits"))
    each = sizes.join(names, "pattern_id").join(hits, "pattern_id", "left")
    found = F.count(F.when(F.col("hits") >= cfg.cover * F.col("ring_txns"), 1))
    return each.groupBy("typology").agg(F.count("*").alias("rings"), found.alias("rings_found")).withColumn("rate", F.col("rings_found") / F.col("rings")).orderBy("rate", "typology")


def separation(scored: DataFrame, names: list[str]) -> DataFrame:
    """(feature, p50, p90, p99 of positives and of others, lift): percentiles at index int(q * (n - 1)) of the sorted values."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("x")) for n in names])
    long = scored.select("positive", F.explode(pairs).alias("p")).select("positive", "p.*")
    # Equal values are counted first; their places come from a range-partitioned running sum, so no task holds a class.
    placed = running(long.groupBy("feature", "positive", "x").agg(F.count("*").alias("m")), ["feature", "positive"], "x", "m")
    n = long.groupBy("feature", "positive").agg(F.count("*").alias("n"))
    i = lambda q: F.floor(q * (F.col("n") - 1))
    at = lambda q: F.max(F.when((F.col("before") <= i(q)) & (i(q) < F.col("before") + F.col("m")), F.col("x")))
    each = placed.join(F.broadcast(n), ["feature", "positive"]).groupBy("feature", "positive").agg(at(0.5).alias("p50"), at(0.9).alias("p90"), at(0.99).alias("p99"))
    of = lambda q, yes: F.max(F.when(F.col("positive") == yes, F.col(q)))
    out = each.groupBy("feature").agg(*[of(q, y).alias(f"{q}_{name}") for q in ("p50", "p90", "p99") for y, name in ((True, "ring"), (False, "other"))])
    return out.withColumn("lift", F.when(F.coalesce("p50_other", F.lit(0.0)) == 0, 0.0).otherwise(F.col("p50_ring") / F.col("p50_other")))


def base_rate(ledger: DataFrame) -> Column:
    return F.avg(F.col("is_laundering").cast("double"))
