from ledgers import ledger
from pyspark.sql import functions as F

from ledgerloom.operators import evaluate


def setup(spark, cands, rows, laundering=(), patterns=None):
    """cands: lists of transfer ids; one candidate each."""
    led = ledger(spark, rows, laundering, patterns)
    pairs = [(w, min(ids), i) for w, ids in enumerate(cands) for i in ids]
    return led, spark.createDataFrame(pairs, "w long, first_txn long, txn_id long").join(led, "txn_id")


ROWS = [(i, i, 1, 2, 10.0) for i in range(1, 200)]
RING = {i: 7 for i in (1, 2, 3, 4)}


def test_cover(spark):
    for ids, want in (([1, 2, 50], 1), ([1, 50], 0)):
        led, m = setup(spark, [ids], ROWS, RING, RING)
        assert evaluate.evaluate(m, led).first()["rings_found"] == want


def test_noise(spark):
    led, m = setup(spark, [[1, 2, 3, 4, *range(20, 120)]], ROWS, RING, RING)
    r = evaluate.evaluate(m, led).first()
    assert (r["rings_found"], r["true_candidates"], r["fp"], r["fp_value"]) == (1, 0, 100, 1000)


def test_unlabelled_laundering(spark):
    led, m = setup(spark, [[1, 2, 3, 4]], ROWS, {1, 2, 3, 4, 9}, RING)
    r = evaluate.evaluate(m, led).first()
    assert (r["tp"], r["fn"]) == (4, 1)


def ranked(spark, scores):
    return evaluate.rank(spark.createDataFrame([(w, f, s) for (w, f), s in scores.items()], "w long, first_txn long, score double"))


def test_budgets(spark):
    led, m = setup(spark, [[50, 51, 52, 53], [1, 2, 3, 4]], ROWS, RING, RING)
    r = {x["k"]: x for x in evaluate.ranked_budgets(ranked(spark, {(0, 50): 0.1, (1, 1): 0.9}), m, led, (1, 2, 1000)).collect()}
    assert sorted(r) == [1, 2]
    assert (r[1]["rings_found"], r[1]["fp"], r[2]["fp"], r[2]["precision"]) == (1, 0, 4, 0.5)


def test_hits_count_every_occurrence(spark):
    # One transfer in two flagged candidates reaches half of a ring of four, as it is counted twice.
    led, m = setup(spark, [[1, 60], [1, 61]], ROWS, RING, RING)
    r = evaluate.ranked_budgets(ranked(spark, {(0, 1): 0.5, (1, 1): 0.4}), m, led, (2,)).first()
    assert r["rings_found"] == 1 and evaluate.evaluate(m, led).first()["rings_found"] == 0


def test_rank_order(spark):
    got = ranked(spark, {(0, 1): 0.5, (1, 1): 0.9, (2, 1): 0.5, (3, 1): 0.9, (4, 1): 0.1}).orderBy("rank").collect()
    assert [r["w"] for r in got] == [1, 3, 0, 2, 4]


def test_threshold(spark):
    s = spark.createDataFrame([(x,) for x in (0.5, 0.9, 0.5, 0.1)], "score double")
    assert [evaluate.threshold(s, n) for n in (0, 1, 2, 4)] == [0.0, 0.9, 0.5, 0.0]


def test_separation(spark):
    rows = spark.createDataFrame([(True, float(i)) for i in range(11)] + [(False, 2.0)], "positive boolean, x double")
    r = evaluate.separation(rows, ["x"]).first()
    assert (r["p50_ring"], r["p90_ring"], r["p99_ring"], r["p50_other"], r["lift"]) == (5, 9, 9, 2, 2.5)
    assert evaluate.separation(rows.where("positive"), ["x"]).first()["lift"] == 0


def test_labels(spark):
    _, m = setup(spark, [[1, 60], [61, 62]], ROWS, RING, RING)
    assert {r["w"]: r["positive"] for r in evaluate.labels(m).collect()} == {0: True, 1: False}
    assert m.agg(F.count("*")).first()[0] == 4


def test_ranking_is_judged_on_its_own_transfers(spark):
    # Of a ring of ten, the only ranked candidate holds two, both flagged: they are the ring as far as this ranking goes.
    ring = dict.fromkeys(range(1, 11), 7)
    led, m = setup(spark, [[1, 2, 50], [3, 4, 5, 6]], ROWS, ring, ring)
    r = evaluate.ranked_budgets(ranked(spark, {(0, 1): 0.5}), m, led, (1,)).first()
    assert (r["rings_found"], r["rings"], r["tp"], r["fn"], r["recall"], r["fp_value"]) == (1, 1, 2, 0, 1.0, 10.0)
    s = evaluate.ranked_shapes(ranked(spark, {(0, 1): 0.5}), m, led, 1).collect()
    assert [(x["rings"], x["rings_found"]) for x in s] == [(1, 1)]


def test_separation_over_many_rows(spark):
    rows = spark.range(5000).select((F.col("id") % 3 == 0).alias("positive"), ((F.col("id") * 7919) % 1000).cast("double").alias("x"))
    r = evaluate.separation(rows, ["x"]).first()
    xs = {y: sorted(float(i * 7919 % 1000) for i in range(5000) if (i % 3 == 0) == y) for y in (True, False)}
    for name, y in (("ring", True), ("other", False)):
        assert [r[f"{p}_{name}"] for p in ("p50", "p90", "p99")] == [xs[y][int(q * (len(xs[y]) - 1))] for q in (0.5, 0.9, 0.99)]
