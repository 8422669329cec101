import random

import pytest
from ledgers import ledger
from pyspark.sql import functions as F

from ledgerloom.config import HOUR_US, Limits, parse_geometries
from ledgerloom.operators import policy


def decide(spark, **row):
    row = {"score": 0.97, "total": 500_000.0, "proposed": "block", "confidence": 0.93} | row
    return policy.apply_policy(spark.createDataFrame([tuple(row.values())], "score double, total double, proposed string, confidence double")).first()


def test_gates(spark):
    assert decide(spark)["action"] == "block" and decide(spark)["adjustments"] == []
    for change, word in (({"score": 0.6}, "score"), ({"confidence": 0.4}, "confidence"), ({"total": 50e6}, "amount")):
        d = decide(spark, **change)
        assert d["action"] == "hold_for_review" and word in d["adjustments"][-1]
    assert decide(spark, score=0.6, confidence=0.1)["adjustments"] == ["block withheld: score below the block bound"]
    assert decide(spark, proposed="allow")["action"] == "hold_for_review" and decide(spark, proposed="allow", score=0.1)["action"] == "allow"
    d = decide(spark, proposed="explode")
    assert (d["action"], d["proposed"]) == ("hold_for_review", "hold_for_review")
    d = decide(spark, confidence=4.2, score=0.3)
    assert (d["confidence"], d["action"]) == (1.0, "hold_for_review")


def test_rule_never_blocks(spark):
    rows = spark.createDataFrame([(0.99,), (0.5,), (0.1,)], "score double")
    a, c = policy.rule_tier(F.col("score"))
    assert [tuple(r) for r in rows.select(a, c).collect()] == [("hold_for_review", 0.99), ("hold_for_review", 0.5), ("allow", 0.9)]


def leases(spark, action, n):
    df = spark.createDataFrame([(0, 1, [str(i) for i in range(n)], action, 0, 72)], "w long, first_txn long, accounts array<string>, action string, imposed_us long, pass_hours int")
    return [r["tier"] for r in policy.leases(df).collect()]


def test_leases(spark):
    assert leases(spark, "block", 3) == ["frozen"] * 3 and leases(spark, "hold_for_review", 3) == ["watch"] * 3 and leases(spark, "allow", 3) == []
    assert leases(spark, "block", 26) == [] and len(leases(spark, "block", 25)) == 25 and len(leases(spark, "hold_for_review", 40)) == 40


def fold(history):
    """The register, one event after the other."""
    state, out = None, []
    for tier, expires in history:
        if state is None:
            state, what = (tier, expires), "new"
        elif tier == "frozen" and state[0] == "watch" or tier == state[0] and expires > state[1]:
            state, what = (tier, expires), "extended"
        else:
            what = "ignored"
        out.append(what)
    return state, out


def test_register_is_the_fold(spark):
    rng = random.Random(3)
    rows, want = [], []
    for a in range(60):
        history = [(rng.choice(["frozen", "watch"]), (t + rng.randrange(1, 30)) * HOUR_US) for t in range(rng.randrange(1, 8))]
        want += [(str(a), t, o) for t, o in enumerate(fold(history)[1])]
        rows += [(str(a), tier, t * HOUR_US, e, 72, 0, t) for t, (tier, e) in enumerate(history)]
    df = spark.createDataFrame(rows, "account string, tier string, imposed_us long, expires_us long, pass_hours int, w long, first_txn long")
    got = sorted((r["account"], r["first_txn"], r["outcome"]) for r in policy.register(df).collect())
    assert got == sorted(want)


def test_freeze_activity(spark):
    e = spark.createDataFrame([("1", "frozen", 0, 72 * HOUR_US)], "account string, tier string, imposed_us long, expires_us long")
    led = ledger(spark, [(1, -1, 1, 2, 9), (2, 10, 1, 2, 9), (3, 72, 1, 2, 9), (4, 100, 1, 2, 9), (5, 0, 2, 1, 9)])
    assert {r["txn_id"] for r in policy.stopped(led, e).where("stopped").collect()} == {2}  # what a frozen account sends, not what it gets


def test_watch_does_not_stop(spark):
    e = spark.createDataFrame([("1", "frozen", 0, 72 * HOUR_US), ("1", "watch", HOUR_US, 200 * HOUR_US), ("1", "frozen", 2 * HOUR_US, 100 * HOUR_US)], "account string, tier string, imposed_us long, expires_us long")
    led = ledger(spark, [(1, 80, 1, 2, 9)])
    assert policy.stopped(led, e.limit(2)).where("stopped").count() == 0 and policy.stopped(led, e).where("stopped").count() == 1


RING = [(1, 0, 1, 2, 100), (2, 1, 2, 3, 100), (3, 2, 3, 1, 100), (4, 80, 1, 2, 500), (5, 100, 2, 3, 400)]


def test_ceiling(spark):
    led = ledger(spark, RING, range(1, 6), dict.fromkeys(range(1, 6), 1))
    r = policy.ceiling(led, [(72, 24)]).first()
    assert (r["total"], r["stoppable"], r["never_visible"]) == (1200, 900, 0)
    two = ledger(spark, RING[:2], (1, 2), {1: 1, 2: 1})
    r = policy.ceiling(two, [(72, 24)]).first()
    assert (r["never_visible"], r["stoppable"]) == (1, 0)
    late = ledger(spark, [*RING[:4], (5, 200, 2, 3, 400)], range(1, 6), dict.fromkeys(range(1, 6), 1))
    r = policy.ceiling(late, [(72, 24)], span=(72, 100)).first()
    assert (r["stoppable"], r["total"]) == (500, 500)


def test_held_accounts(spark):
    log = [(1, "impose", "a", "frozen", 0, 50), (2, "impose", "a", "watch", 0, 90), (3, "impose", "b", "frozen", 0, 50), (4, "lift", "b", None, None, None), (5, "impose", "b", "watch", 0, 20)]
    df = spark.createDataFrame(log, "seq long, event string, account string, tier string, imposed_us long, expires_us long")
    assert {r["account"]: (r["tier"], r["expires_us"]) for r in policy.held_accounts(df).collect()} == {"a": ("frozen", 50), "b": ("watch", 20)}


def test_geometries():
    assert [(g.window_hours, g.stride_hours) for g in parse_geometries("72/24, 24/6")] == [(72, 24), (24, 6)]
    for bad in ("72", "6/24", "5/0", "a/b"):
        with pytest.raises(ValueError):
            parse_geometries(bad)
    assert Limits().watch_hours == 336


def source(spark, cands, width=72, stride=24, budget=0, enforces=True):
    rows = [(w, f, at * HOUR_US, accounts, score, total) for w, (f, at, accounts, score, total) in enumerate(cands)]
    return policy.Source(width, stride, spark.createDataFrame(rows, "w long, first_txn long, window_start long, accounts array<string>, score double, total double"), budget, Limits(freeze_hours=width), enforces)


def test_replay(spark):
    # One ring of accounts 1 to 3 is seen in [0, 72); at its close all are frozen until 144.
    led = ledger(spark, [*RING[:3], (4, 80, 1, 2, 500), (5, 100, 9, 3, 400), (6, 90, 2, 8, 50), (7, 150, 1, 2, 60)], (1, 2, 3, 4), dict.fromkeys((1, 2, 3, 4), 1))
    s = source(spark, [(1, 0, ["1", "2", "3"], 0.95, 300.0), (2, 0, ["7"], 0.2, 1.0)])
    row, per = policy.replay(led, [s])
    r = row.first()
    assert (r["windows"], r["decisions"], r["blocks"], r["holds"], r["allows"], r["declined"]) == (1, 2, 1, 0, 1, 0)
    assert (r["from_us"], r["runway_us"], r["unprotected"], r["unprotected_laundering_value"]) == (72 * HOUR_US, 78 * HOUR_US, 3, 300)
    assert (r["checked"], r["laundering"], r["value"], r["laundering_value"]) == (4, 1, 1010, 500)
    assert (r["stopped"], r["stopped_laundering"], r["value_stopped"], r["rings_hit"]) == (2, 1, 550, 1)  # 4 and 6; 5 goes to a frozen account
    assert (r["precision"], r["interception"], r["ceiling_value"], r["of_ceiling"]) == (500 / 550, 1.0, 500, 1.0)
    p = per.first()
    assert (p["decisions"], p["blocks"], p["new"], p["escalations"]) == (2, 1, 3, 0)


def test_replay_budget_limits_and_passes(spark):
    led = ledger(spark, [(i, i, 1, 2, 10) for i in range(200)])
    many = [str(i) for i in range(26)]
    wide = source(spark, [(1, 0, many, 0.99, 1.0), (2, 0, ["1"], 0.95, 1.0), (3, 24, ["1"], 0.4, 1.0)], budget=2)
    r = policy.replay(led, [wide])[0].first()
    assert (r["decisions"], r["blocks"], r["declined"], r["accounts_frozen"], r["windows"]) == (2, 2, 1, 1, 2)
    bound = policy.decide([wide])[0].where("declined").first()["bound"]
    assert "26" in bound and "25" in bound
    narrow = source(spark, [(1, 0, ["1", "2"], 0.95, 1.0)], 24, 6)
    row, per = policy.replay(led, [wide, narrow])
    got = {p["pass_hours"]: (p["decisions"], p["new"], p["escalations"]) for p in per.collect()}
    assert got == {24: (1, 2, 0), 72: (2, 0, 1)} and row.first()["stopped"] == 24 + 72  # 24 to 47, then 72 to 143
    off = policy.replay(led, [source(spark, [(1, 0, ["1"], 0.95, 1.0)], enforces=False), narrow])
    assert off[0].first()["stopped"] == 24 and {p["pass_hours"]: p["new"] for p in off[1].collect()} == {24: 2, 72: 0}
    assert policy.replay(led, [source(spark, [(1, 500, ["1"], 0.95, 1.0)])])[0].first()["runway_us"] < 0


def test_lookups(spark):
    held = spark.createDataFrame([("a", "frozen", 0, 50), ("a", "watch", 0, 90), ("b", "frozen", 0, 50)], "account string, tier string, imposed_us long, expires_us long")
    past = policy.history(held, spark.createDataFrame([("b", 20), ("b", 30), ("a", 95)], "account string, lifted_us long"))
    assert {(r["account"], r["tier"]): r["lifted_us"] for r in past.collect()} == {("a", "frozen"): None, ("a", "watch"): None, ("b", "frozen"): 20}
    at = lambda t: {r["account"]: r["tier"] for r in policy.active_at(past, t).collect()}
    assert at(0) == {"a": "frozen", "b": "frozen"} and at(20) == {"a": "frozen"} and at(50) == {"a": "watch"} and at(90) == {}
    asked = spark.createDataFrame([("a", 60), ("b", 10), ("c", 1)], "account string, at_us long")
    assert {r["account"] for r in policy.lookup(past, asked, stops=True).collect()} == {"b"}


def test_held_accounts_expire(spark):
    log = spark.createDataFrame([(1, "impose", "a", "frozen", 0, 50), (2, "impose", "b", "watch", 0, 90)], "seq long, event string, account string, tier string, imposed_us long, expires_us long")
    assert {r["account"]: r["expired"] for r in policy.held_accounts(log, 50).collect()} == {"a": True, "b": False}


def test_rings_without_a_window(spark):
    two = ledger(spark, [(1, 0, 1, 2, 100), (2, 500, 2, 3, 100)], (1, 2), {1: 1, 2: 1})
    r = policy.ceiling(two, [(72, 24)]).first()
    assert (r["never_visible"], r["stoppable"], r["total"]) == (1, 0, 200)
