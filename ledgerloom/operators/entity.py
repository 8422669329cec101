"""Entity resolution of card transactions, and rings of clients that share corroborating values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import client_key, size_band
from ledgerloom.operators.components import components

#: The built-in rules with the most members a shared value may have.
FANOUT = {"device_fingerprint": 20, "shared_card": 10}


def resolve(cards: DataFrame) -> DataFrame:
    """The transactions with ``client``: the least transaction id of their holder's key, stable under any row order."""
    keyed = cards.withColumn("client_key", client_key(F.col("card1"), F.col("addr1"), F.col("d1").cast("double"), F.col("transaction_dt"), F.col("transaction_id")))
    clients = keyed.groupBy("client_key").agg(F.min("transaction_id").alias("client"))
    return keyed.join(clients, "client_key")


def memberships(resolved: DataFrame) -> DataFrame:
    """(rule, value, client), each once."""
    rules = F.array(F.struct(F.lit("device_fingerprint").alias("rule"), F.col("device").alias("value")), F.struct(F.lit("shared_card").alias("rule"), F.col("card1").cast("string").alias("value")))
    return resolved.select("client", F.explode(rules).alias("r")).select("r.rule", "r.value", "client").where("value IS NOT NULL").distinct()


def _cap(rule: Column) -> Column:
    return F.coalesce(*[F.when(rule == k, n) for k, n in FANOUT.items()])


def link_groups(members: DataFrame) -> DataFrame:
    """(rule, value, members, accepted) of every value that at least two clients share."""
    return members.groupBy("rule", "value").agg(F.count("*").alias("members")).where("members >= 2").withColumn("accepted", F.col("members") <= _cap(F.col("rule")))


def link_pairs(members: DataFrame, corroboration: int = 2) -> DataFrame:
    """(a, b, evidence, linked): pairs within accepted groups, whose size the rules bound."""
    inside = members.join(link_groups(members).where("accepted").select("rule", "value"), ["rule", "value"])
    x, y = inside.alias("x"), inside.alias("y")
    pairs = x.join(y, (F.col("x.rule") == F.col("y.rule")) & (F.col("x.value") == F.col("y.value")) & (F.col("x.client") < F.col("y.client")))
    n = pairs.groupBy(F.col("x.client").alias("a"), F.col("y.client").alias("b")).agg(F.count("*").alias("evidence"))
    return n.withColumn("linked", F.col("evidence") >= max(1, corroboration))


def rings(pairs: DataFrame) -> DataFrame:
    """(client, ring): components of linked pairs, each known by its least client."""
    return components(pairs.where("linked")).select(F.col("node").alias("client"), F.col("component").alias("ring"))


def used_groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Accepted groups with two members of a linked pair: (rule, value, ring client, members)."""
    inside = members.join(link_groups(members).where("accepted"), ["rule", "value"])
    x, y = inside.alias("x"), inside.select("rule", "value", F.col("client").alias("b")).alias("y")
    met = x.join(y, ["rule", "value"]).where("client < b").select("rule", "value", "members", F.col("client").alias("a"), "b")
    return met.join(pairs.where("linked").select("a", "b"), ["a", "b"]).groupBy("rule", "value", "members").agg(F.min("a").alias("client"))


def evidence(members: DataFrame, pairs: DataFrame, found: DataFrame) -> DataFrame:
    """(ring, rule, value, members) of the groups that made links."""
    return used_groups(members, pairs).join(found, "client").select("ring", "rule", "value", "members")


def rule_stats(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(rule, accepted, rejected, used)."""
    used = used_groups(members, pairs).groupBy("rule").agg(F.count("*").alias("used"))
    n = link_groups(members).groupBy("rule").agg(F.count(F.when(F.col("accepted"), 1)).alias("accepted"), F.count(F.when(~F.col("accepted"), 1)).alias("rejected"))
    return n.join(used, "rule", "left").withColumn("used", F.coalesce("used", F.lit(0)))


def concentration(resolved: DataFrame, found: DataFrame) -> DataFrame:
    """(in_ring, transactions, fraud, rate)."""
    rows = resolved.join(found, "client", "left").withColumn("in_ring", F.col("ring").isNotNull())
    return rows.groupBy("in_ring").agg(F.count("*").alias("transactions"), F.count(F.when(F.col("is_fraud"), 1)).alias("fraud")).withColumn("rate", F.round(100 * F.col("fraud") / F.col("transactions"), 3))


def size_bands(found: DataFrame) -> DataFrame:
    """(band, rings, clients) of ring sizes, smallest first."""
    n = found.groupBy("ring").agg(F.count("*").alias("clients"))
    return n.groupBy(size_band(F.col("clients")).alias("band")).agg(F.count("*").alias("rings"), F.sum("clients").alias("clients"), F.min("clients").alias("least")).orderBy("least").drop("least")
