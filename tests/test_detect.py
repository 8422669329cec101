import random

import pytest
from ledgers import ledger
from pyspark.sql import functions as F

from ledgerloom.config import HOUR_US, Detector
from ledgerloom.operators import detect
from ledgerloom.operators.components import components, window_components

CFG = Detector(formats=None)


def found(spark, rows, cfg=CFG):
    return detect.candidates(ledger(spark, rows), cfg)[0].orderBy("w", "first_txn").collect()


def test_chain_is_one_candidate(spark):
    got = found(spark, [(1, 0, 1, 2, 9), (2, 1, 2, 3, 9), (3, 2, 3, 4, 9)])
    assert len(got) == 1 and got[0]["window_start"] == 0 and got[0]["accounts"] == ["1", "2", "3", "4"]


def test_windows_keep_groups_apart(spark):
    tri = lambda i, h, a, b, c: [(i, h, a, b, 9), (i + 1, h + 1, b, c, 9), (i + 2, h + 2, c, a, 9)]
    got = found(spark, tri(1, 0, 1, 2, 3) + tri(4, 500, 1, 5, 6))
    assert [len(r["accounts"]) for r in got] == [3, 3]


def test_hub_is_left_out(spark):
    rows = [(i, 1, 99, 100 + i, 9) for i in range(1, 41)] + [(50, 1, 1, 2, 9), (51, 2, 2, 3, 9), (52, 3, 3, 1, 9), (60, 1, 4, 5, 9), (61, 2, 5, 6, 9), (62, 3, 6, 4, 9), (63, 3, 99, 1, 9), (64, 3, 99, 4, 9)]
    got = found(spark, rows, Detector(formats=None, max_degree=10))
    assert len(got) == 2 and all("99" not in r["accounts"] for r in got)


def test_size_limits(spark):
    assert found(spark, [(i, i, 1, 2, 9) for i in (1, 2, 3)]) == []
    assert found(spark, [(i, i, 1, 1 + i, 9) for i in range(1, 7)], Detector(formats=None, max_accounts=3)) == []


def test_window_counts(spark):
    cfg = Detector(formats=None, window_hours=24, stride_hours=24)
    rows = detect.window_counts(ledger(spark, [(1, 0, 1, 2, 9), (2, 1, 1, 2, 9), (3, 2, 1, 2, 9), (4, 400, 1, 2, 9)]), cfg).collect()
    assert len(rows) >= 17 and sum(r["txns"] for r in rows) == 4


def test_active_period(spark):
    days = lambda *ns: ledger(spark, [(k * 1000 + i, 24 * k + i / 1000, 1, 2, 9) for k, n in enumerate(ns) for i in range(n)])
    tail = days(*[100] * 10, *[2] * 5)
    assert detect.active_end(tail).first()[0] == 10 * 24 * HOUR_US and detect.trim(tail).count() == 1000
    assert detect.trim(days(*[50] * 12)).count() == 600
    assert detect.active_end(ledger(spark, [])).first()[0] is None


def test_split(spark):
    assert detect.split_time(ledger(spark, [(1, 0, 1, 2, 9), (2, 100, 1, 2, 9)]), 0.7).first()[0] == 70 * HOUR_US


def test_scan(spark):
    df = ledger(spark, [(1, 0, 1, 2, 9), (2, 0, 1, 2, 5)])
    assert detect.scan(df, Detector(min_amount=6)).count() == 1 and detect.scan(df, Detector(formats=("Wire",))).count() == 0 and detect.scan(df, Detector(formats=None)).count() == 2


def naive(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_agree(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    want = {k: v for k, v in naive([(a, b) for a, b in edges if a != b]).items()}
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r["node"]: r["component"] for r in components(df).collect()} == want
    both = spark.createDataFrame([(w, a + w, b + w) for a, b in edges for w in (0, 1000)], "w long, src long, dst long")
    local = sorted(map(tuple, window_components(both).collect()))
    assert local == sorted(map(tuple, window_components(both, local_limit=1).collect()))
    assert {n: c for w, n, c in local if w == 0} == naive(edges)


def test_components_empty(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert components(spark.createDataFrame([(None, 1), (2, 2)], "a long, b long")).count() == 0


def test_quiet_formats(spark):
    assert detect.assign_windows(ledger(spark, []), CFG).agg(F.count("*")).first()[0] == 0
