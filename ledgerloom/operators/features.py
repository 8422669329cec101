"""Features of candidate groups, each one aggregate over the members or their accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.config import HOUR_US
from ledgerloom.functions.scalars import clamp01
from ledgerloom.storage import written

KEY = ["w", "first_txn"]


def accounts_of(members: DataFrame) -> DataFrame:
    """(w, first_txn, acct, in_amt, out_amt, sends, recvs)."""
    zero = F.lit(0.0)
    ends = members.select(*KEY, F.explode(F.array(F.struct(F.col("src").alias("acct"), zero.alias("i"), F.col("amount").alias("o"), F.lit(1).alias("s"), F.lit(0).alias("r")), F.struct(F.col("dst").alias("acct"), F.col("amount").alias("i"), zero.alias("o"), F.lit(0).alias("s"), F.lit(1).alias("r")))).alias("e"))
    return ends.groupBy(*KEY, F.col("e.acct").alias("acct")).agg(F.sum("e.i").alias("in_amt"), F.sum("e.o").alias("out_amt"), F.sum("e.s").alias("sends"), F.sum("e.r").alias("recvs"))


def amounts(members: DataFrame) -> DataFrame:
    n, mean = F.count("*"), F.avg("amount")
    reuse = 1 - F.countDistinct("src", "dst") / n
    cv = F.stddev_pop("amount") / mean
    return members.groupBy(*KEY).agg(n.alias("txns"), F.sum("amount").alias("total"), F.greatest(F.lit(0.0), F.max("amount")).alias("max_amount"), mean.alias("mean"), ((F.max("ts_us") - F.min("ts_us")) / HOUR_US).alias("span_hours"), reuse.alias("pair_reuse"), F.when(mean <= 0, 0.0).otherwise(1 / (1 + cv)).alias("amount_uniformity"))


def flows(members: DataFrame) -> DataFrame:
    through = (F.col("in_amt") > 0) & (F.col("out_amt") > 0)
    kept = F.when(through, F.least(F.col("out_amt") / F.col("in_amt"), F.col("in_amt") / F.col("out_amt")))
    count = lambda c: F.count(F.when(c, 1))
    sent, got = F.col("sends") > 0, F.col("recvs") > 0
    only_s, only_r = count(sent & ~got), count(got & ~sent)
    balance = F.when(only_s + only_r == 0, 0.0).otherwise(2 * F.least(only_s, only_r) / (only_s + only_r))
    return accounts_of(members).groupBy(*KEY).agg(F.count("*").alias("accounts"), count(sent).alias("senders"), count(got).alias("receivers"), (count(through) / F.count("*")).alias("pass_through"), F.coalesce(F.avg(kept), F.lit(0.0)).alias("conservation"), balance.alias("partition_balance"))


def typology(accounts: Column, senders: Column, receivers: Column) -> Column:
    """The first shape that fits, by who sends and who receives."""
    both = senders + receivers - accounts
    return F.when(senders == 1, "FAN-OUT").when(receivers == 1, "FAN-IN").when(both == accounts, "CYCLE").when(both == 0, "BIPARTITE").otherwise("MIXED")


def burstiness(members: DataFrame) -> DataFrame:
    """Finite-size burstiness of the gaps between transfers."""
    gap = (F.col("ts_us") - F.lag("ts_us").over(Window.partitionBy(*KEY).orderBy("ts_us", "txn_id"))) / 1e6
    g = members.withColumn("gap", gap).groupBy(*KEY).agg(F.count("gap").alias("m"), F.avg("gap").alias("mean"), F.stddev_pop("gap").alias("sd"))
    r, more, less = F.col("sd") / F.col("mean"), F.sqrt(F.col("m") + 1), F.sqrt(F.col("m") - 1)
    under = (more - 2) * r + less
    good = (F.col("m") >= 1) & (F.col("mean") > 0)
    value = F.when(good & (under != 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (more * r - less) / under))).otherwise(0.0)
    return g.select(*KEY, value.alias("burstiness"))


def max_hour_share(members: DataFrame) -> DataFrame:
    """The largest share of the transfers within an hour, both ends included."""
    hour = Window.partitionBy(*KEY).orderBy("ts_us").rangeBetween(-HOUR_US, 0)
    return members.withColumn("near", F.count("*").over(hour)).groupBy(*KEY).agg((F.max("near") / F.count("*")).alias("max_hour_share"))


def fast_forward(members: DataFrame) -> DataFrame:
    """How soon, against the span, money that came in first goes on: 1 less the median delay over the span."""
    first_in = members.groupBy(*KEY, F.col("dst").alias("acct")).agg(F.min("ts_us").alias("came"))
    out = members.select(*KEY, F.col("src").alias("acct"), F.col("ts_us").alias("went"))
    delay = first_in.join(out, [*KEY, "acct"]).where("went >= came").groupBy(*KEY, "acct").agg((F.min("went") - F.first("came")).alias("delay"))
    median = delay.groupBy(*KEY).agg(F.expr("percentile(delay, 0.5)").alias("median"))
    span = members.groupBy(*KEY).agg((F.max("ts_us") - F.min("ts_us")).alias("span"))
    value = F.when(F.col("median").isNull(), 0.0).when(F.col("span") <= 0, 1.0).otherwise(clamp01(1 - F.col("median") / F.col("span")))
    return span.join(median, KEY, "left").select(*KEY, value.alias("fast_forward"))


def features(members: DataFrame) -> DataFrame:
    """All features of every candidate. Members are written first: six aggregates read them."""
    members = written(members, "members")
    out = amounts(members)
    for part in (flows(members), burstiness(members), max_hour_share(members), fast_forward(members)):
        out = out.join(part, KEY)
    return out.withColumn("density", F.col("txns") / F.col("accounts")).withColumn("typology", typology(F.col("accounts"), F.col("senders"), F.col("receivers")))


_LOG = {"log_total": "total", "log_max": "max_amount", "log_mean": "mean", "log_txns": "txns", "log_accounts": "accounts"}
_BASE = ["log_total", "log_max", "log_mean", "conservation", "pass_through", "log_txns", "log_accounts", "density", "span_hours"]
_TEMPORAL = [*_BASE, "burstiness", "max_hour_share", "fast_forward"]
#: Names of the features of every set, in order.
SETS = {
    "base": _BASE, "temporal": _TEMPORAL, "registry": [*_TEMPORAL, "registry_share"], "anomaly": [*_TEMPORAL, "anomaly"], "all": [*_TEMPORAL, "registry_share", "anomaly"],
    "bip-balance": [*_TEMPORAL, "partition_balance"], "bip-reuse": [*_TEMPORAL, "pair_reuse"], "bip-uniform": [*_TEMPORAL, "amount_uniformity"],
    "bipartite": [*_TEMPORAL, "partition_balance", "pair_reuse", "amount_uniformity"],
}


def names_for(feature_set: str) -> list[str]:
    """Names of a set; an unknown set is the default."""
    return SETS.get(feature_set, _TEMPORAL)


def vector(feature_set: str = "temporal") -> list[Column]:
    return [F.log1p(F.col(_LOG[n]).cast("double")).alias(n) if n in _LOG else F.col(n).cast("double").alias(n) for n in names_for(feature_set)]
