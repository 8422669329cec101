import math

import pytest
from ledgers import members

from ledgerloom.operators import features as feats


def one(spark, rows):
    return feats.features(members(spark, rows)).first()


def chain(hours, amount=100.0):
    n = len(hours)
    return [(i + 1, h, i % 3, (i + 1) % 3, amount) for i, h in enumerate(hours)] if n else []


def test_flow_amounts(spark):
    f = one(spark, [(1, 0, 1, 2, 1000), (2, 1, 2, 3, 1000)])
    assert f["conservation"] == 1 and f["pass_through"] == pytest.approx(1 / 3)
    a, b = one(spark, [(1, 0, 1, 2, 1000), (2, 1, 2, 3, 900)]), one(spark, [(1, 0, 1, 2, 900), (2, 1, 2, 3, 1000)])
    assert a["conservation"] == pytest.approx(b["conservation"]) and a["conservation"] <= 1
    assert one(spark, [(1, 0, 1, 2, 1000), (2, 1, 2, 3, 1000), (3, 2, 2, 4, 0.0001)])["conservation"] >= 0.99


def test_span_and_amounts(spark):
    f = one(spark, chain([0, 6, 30]))
    assert (f["span_hours"], f["density"], f["total"], f["max_amount"], f["mean"]) == (30, 1, 300, 100, 100)


@pytest.mark.parametrize(("hours", "want", "slack"), [([0, 1, 2, 3, 4, 5], -1, 1e-9), ([0, 0.01, 0.02, 0.03, 100], 1, 0.02), ([0, 1], 0, 0), ([5, 5, 5], 0, 0), ([0], 0, 0)])
def test_burstiness(spark, hours, want, slack):
    assert one(spark, chain(hours))["burstiness"] == pytest.approx(want, abs=slack or 1e-12)


@pytest.mark.parametrize(("hours", "want"), [([0, 24, 48, 72], 0.25), ([0, 0.1, 0.2, 100], 0.75), ([23.9, 24, 24.1], 1)])
def test_max_hour_share(spark, hours, want):
    assert one(spark, chain(hours))["max_hour_share"] == pytest.approx(want)


def test_fast_forward(spark):
    ff = lambda rows: one(spark, rows)["fast_forward"]
    assert ff([(1, 0, 1, 2, 9), (2, 0.1, 2, 3, 9), (3, 100, 4, 5, 9)]) >= 0.99
    assert ff([(1, 0, 1, 2, 9), (2, 95, 2, 3, 9), (3, 100, 4, 5, 9)]) <= 0.1
    assert ff([(1, 0, 1, 2, 9), (2, 100, 3, 4, 9)]) == 0
    assert ff([(1, 10, 2, 9, 9), (2, 50, 1, 2, 9), (3, 99, 2, 3, 9)]) <= 0.6
    assert ff([(1, 5, 1, 2, 9), (2, 5, 2, 3, 9)]) == 1


def test_bipartite(spark):
    pairs = [(1, 0, 1, 2, 5), (2, 1, 3, 4, 5), (3, 2, 5, 6, 5)]
    fan = [(1, 0, 1, 2, 5), (2, 1, 1, 3, 5), (3, 2, 1, 4, 5)]
    tri = [(1, 0, 1, 2, 5), (2, 1, 2, 3, 5), (3, 2, 3, 1, 5)]
    assert [one(spark, r)["partition_balance"] for r in (pairs, fan, tri)] == [1, 0.5, 0]
    same = [(i, i, 1, 2, 5) for i in (1, 2, 3)]
    assert one(spark, pairs)["pair_reuse"] == 0 and one(spark, same)["pair_reuse"] == pytest.approx(2 / 3)
    assert one(spark, [(1, 0, 1, 2, 5), (2, 1, 2, 1, 5), (3, 2, 1, 3, 5)])["pair_reuse"] == 0
    assert one(spark, same)["amount_uniformity"] == 1 and one(spark, [(1, 0, 1, 2, 0), (2, 1, 1, 2, 0)])["amount_uniformity"] == 0
    a, b = [(1, 0, 1, 2, 3), (2, 1, 1, 2, 8)], [(1, 0, 1, 2, 3000), (2, 1, 1, 2, 8000)]
    assert one(spark, a)["amount_uniformity"] == pytest.approx(one(spark, b)["amount_uniformity"])


def test_typology(spark):
    shapes = {
        "FAN-OUT": [(1, 0, 1, 2, 5), (2, 1, 1, 3, 5)],
        "FAN-IN": [(1, 0, 2, 1, 5), (2, 1, 3, 1, 5)],
        "CYCLE": [(1, 0, 1, 2, 5), (2, 1, 2, 3, 5), (3, 2, 3, 1, 5)],
        "BIPARTITE": [(1, 0, 1, 2, 5), (2, 1, 3, 2, 5), (3, 2, 3, 4, 5)],
        "MIXED": [(1, 0, 1, 2, 5), (2, 1, 2, 3, 5), (3, 2, 4, 3, 5)],
    }
    assert {k: one(spark, v)["typology"] for k, v in shapes.items()} == {k: k for k in shapes}


def test_vectors(spark):
    row = spark.createDataFrame([(999.0, 99.0, 9.0, 0.5, 0.25, 9, 3, 3.0, 12.0)], "total double, max_amount double, mean double, conservation double, pass_through double, txns long, accounts long, density double, span_hours double")
    got = list(row.select(*feats.vector("base")).first())
    assert got == pytest.approx([math.log1p(999), math.log1p(99), math.log1p(9), 0.5, 0.25, math.log1p(9), math.log1p(3), 3, 12])
    assert feats.names_for("nonsense") == feats.names_for("temporal") and len(feats.names_for("bipartite")) == 15 and len(feats.names_for("all")) == 14
