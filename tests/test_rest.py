import math
import random

import numpy as np
import pytest
from ledgers import ledger
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ledgerloom.config import HOUR_US, Detector, Forest, RegistrySpec, Training
from ledgerloom.functions import formats, scalars
from ledgerloom.operators import chain, components, entity, latency, models, registry, rowscorer
from ledgerloom.plans import catalog
from ledgerloom.sources import aml, cardfiles, env
from ledgerloom.streaming import closures


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_scalars(spark):
    v = lambda c: value(spark, c)
    assert [v(scalars.normalize_bank(F.lit(x))) for x in ("0012", "000", "", None)] == ["12", "0", "0", "0"]
    assert v(scalars.null_number(F.lit("404.0"), "short")) == 404 and v(scalars.null_number(F.lit(""), "int")) is None
    assert str(v(scalars.exact_decimal(F.lit("-42.50"), 20, 2))) == "-42.50" and str(v(scalars.exact_decimal(F.lit("75.887"), 12, 3))) == "75.887"
    for bad in ("", "12,34"):
        with pytest.raises(PySparkException):
            v(scalars.exact_decimal(F.lit(bad), 12, 3))
    assert [v(scalars.average_path(F.lit(n))) for n in (1, 2)] == [0, 1]
    assert v(scalars.average_path(F.lit(256))) == pytest.approx(2 * (math.log(255) + scalars.EULER) - 2 * 255 / 256) == pytest.approx(models.average_path(256))
    assert [v(scalars.ratio(F.lit(5000.0), F.lit(m))) for m in (0.0, 1000.0)] == [1, 5]
    assert v(scalars.sigmoid(F.lit(-800.0))) == 0 and v(scalars.sigmoid(F.lit(800.0))) == 1
    closes = [v(scalars.next_closure(F.lit(0), F.lit(t * HOUR_US), 72 * HOUR_US, 24 * HOUR_US)) // HOUR_US for t in (0, 10, 72, 73, 96, 97)]
    assert closes == [72, 72, 72, 96, 96, 120]
    assert formats.money(3.13e9) == "3.13bn" and formats.thousands(95318) == "95,318" and formats.account_label("1|2") == "2 @ 1"


def test_logistic(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] > 0).astype(float)
    df = spark.createDataFrame([(float(a), float(b), bool(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y boolean")
    r = models.train(df, [F.col("a"), F.col("b")], ["a", "b"], "y")
    assert abs(r.weights[0]) > 5 * abs(r.weights[1]) and r.explain()[0][0] == "a"
    s = df.select("y", r.score([F.col("a"), F.col("b")]).alias("s")).toPandas()
    assert s[s.y].s.mean() > 0.8 > 0.2 > s[~s.y].s.mean()
    far = models.train(df, [F.col("a"), F.col("b")], ["a", "b"], "y", Training(epochs=5), most_rows=1)
    near = models.train(df, [F.col("a"), F.col("b")], ["a", "b"], "y", Training(epochs=5))
    assert far.weights == pytest.approx(near.weights) and far.bias == pytest.approx(near.bias)
    assert models.descend(np.zeros((0, 2)), np.zeros(0))[0].tolist() == [0, 0]


def test_components_settle_or_raise(spark):
    line = spark.range(40).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert components.components(line).agg(F.count("*"), F.max("component")).first() == (41, 0)
    with pytest.raises(RuntimeError, match="settled"):
        components.components(line, rounds=1)


def test_forest(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(500, 2)), [[9.0, 9.0]]])
    f = models.IsolationForest(x, Forest(trees=50))
    s = f.score(x)
    assert s.argmax() == 500 and ((s > 0) & (s < 1)).all() and (models.IsolationForest(x, Forest(trees=50)).score(x) == s).all()
    df = spark.createDataFrame([(float(a), float(b)) for a, b in x], "a double, b double")
    assert models.anomaly(df, df, [F.col("a"), F.col("b")]).orderBy(F.col("anomaly").desc()).first()["a"] == 9


def test_forest_draws_from_all_rows(spark):
    # More rows than any driver-side bound, most of them one vector, that with the least hash.
    vectors = spark.range(100).select(F.col("id").cast("double").alias("a"), F.lit(1.0).alias("b"))
    often = vectors.orderBy(F.xxhash64("a", "b")).first()["a"]
    rows = spark.range(100_000).select(F.when(F.col("id") < 60_000, F.lit(often)).otherwise((F.col("id") % 100).cast("double")).alias("a"), F.lit(1.0).alias("b"))
    x, drawn = models.bootstrap(rows, [F.col("a"), F.col("b")])
    assert drawn.shape == (100, 256) and set(x[:, 0]) == set(range(100)) and (x[:, 1] == 1).all()
    assert (x[drawn][:, :, 0] == often).mean() == pytest.approx(0.604, abs=0.02)
    again, places = models.bootstrap(rows.repartition(3), [F.col("a"), F.col("b")])
    assert (again == x).all() and (places == drawn).all()
    s = models.anomaly(vectors, rows, [F.col("a"), F.col("b")]).orderBy("anomaly").collect()
    assert s[0]["a"] == often and s[0]["anomaly"] < s[-1]["anomaly"]
    few, places = models.bootstrap(vectors.where("a < 3"), [F.col("a")])
    assert places.shape == (100, 3) and set(few[:, 0]) == {0, 1, 2}
    assert models.anomaly(vectors, vectors.where("a < 0"), [F.col("a")]).agg(F.max("anomaly")).first()[0] == 0


def test_registry(spark):
    rows = [(i, i, i, i + 1, 9) for i in range(1, 400)]
    led = ledger(spark, rows, range(1, 200))
    listed = registry.simulate(led, RegistrySpec(coverage=0.5))
    names = {r["account"] for r in listed.collect()}
    dirty = {str(i) for i in range(1, 201)}
    true = len(names & dirty)
    assert 60 < true < 140 and len(names - dirty) == int(true * 0.05 / 0.95)
    assert registry.simulate(led, RegistrySpec(coverage=0.0)).count() == 0
    cand = spark.createDataFrame([(0, 1, w * HOUR_US, ["1", "2", "3", "4"]) for w in (100, 600)], "w long, first_txn long, window_start long, accounts array<string>")
    known = spark.createDataFrame([("1", 10 * HOUR_US), ("2", 500 * HOUR_US)], "account string, listed_us long")
    both = [registry.annotate(cand.where(F.col("window_start") == w * HOUR_US), known).first()["registry_share"] for w in (100, 600)]
    assert both == [0.25, 0.5] and registry.annotate(cand, None).first()["registry_share"] == 0


def test_amplification(spark):
    led = ledger(spark, [(i, i, i, i + 1, 9) for i in (1, 2, 3, 4)], range(1, 5))
    ranked = spark.createDataFrame([(0, 1, 1, 5, ["1", "2", "3", "4", "5"])], "w long, first_txn long, rank long, window_start long, accounts array<string>")
    listed = lambda *rows: tuple(registry.amplification(ranked, led, spark.createDataFrame(rows, "account string, listed_us long"), 1).first())
    assert listed(("2", 0)) == (1, 1, 4, 4)
    assert listed(("2", 0), ("77", 0)) == (1, 1, 4, 4)  # no candidate holds 77
    assert listed(("2", 6)) == (1, 0, 0, 0)  # listed after the window's start


def test_rowscorer(spark):
    led = ledger(spark, [(1, 0, 1, 2, 10), (2, 1, 1, 3, 10), (3, 500, 1, 2, 10), (4, 501, 9, 9, 10)]).withColumn("ts", scalars.from_micros(F.col("ts_us")))
    v = {r["txn_id"]: r for r in rowscorer.vectors(led.where("txn_id > 2"), led.where("txn_id <= 2")).collect()}
    assert v[3]["log_out_peers"] == pytest.approx(math.log(3)) and v[3]["log_sent"] == pytest.approx(math.log(3)) and v[4]["log_sent"] == 0 and v[4]["sent_ratio"] == 1
    scored = led.withColumn("score", F.col("txn_id").cast("double"))
    assert {r["txn_id"] for r in rowscorer.flag_top(scored, 2).collect()} == {3, 4} and rowscorer.flag_top(scored, 99).count() == 4


def test_entity(spark):
    rows = [(1, False, 86400 * 5, 7, 1, 2, "d"), (2, True, 86400 * 6, 7, 1, 3, "d"), (3, False, 86400 * 5, 7, None, 2, "d"), (4, False, 0, 8, 1, 0, None)]
    cards = spark.createDataFrame(rows, "transaction_id long, is_fraud boolean, transaction_dt long, card1 long, addr1 int, d1 long, device string")
    got = {r["transaction_id"]: r["client"] for r in entity.resolve(cards).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
    pairs = entity.link_pairs(entity.memberships(entity.resolve(cards)))
    assert [tuple(r) for r in pairs.collect()] == [(1, 3, 2, True)]
    assert {r["client"]: r["ring"] for r in entity.rings(pairs).collect()} == {1: 1, 3: 1}


def test_latency(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "ms double")
    r = latency.summary(df, "ms").first()
    assert (r["p50"], r["p95"], r["p99"], r["most"], r["mean"]) == (50, 95, 99, 100, 50.5)
    r = latency.summary(df.where("ms <= 10"), "ms").first()
    assert (r["p50"], r["p95"], r["p99"]) == (5, 10, 10)
    led = ledger(spark, [(1, 0, 1, 2, 9), (2, 1, 1, 2, 9), (3, 30 * 24, 1, 2, 9)] + [(10 + h, 72 + h, 1, 2, 9) for h in range(24)])
    t = latency.decision_times(led, Detector(formats=None)).where("txn_id >= 10")
    assert 0 < t.agg(F.max("wait_us")).first()[0] <= 24 * HOUR_US


def test_chain(spark):
    log = chain.ChainLog("decisions")
    for i in range(5):
        log.append(ring_id=i, action="allow", proposed="allow", confidence=0.5, source="rule", rationale="r", adjustments=["a"], evidence={"x": i})
    assert log.verify() == (5, None)
    changed = chain.ChainLog("decisions", [r | ({"action": "block"} if r["seq"] == 3 else {}) for r in log.rows])
    assert changed.verify() == (5, 3)
    assert chain.ChainLog("decisions", [r for r in log.rows if r["seq"] != 2]).verify() == (4, 3)
    assert chain.ChainLog("decisions", log.rows[1:]).verify() == (4, 2)
    for field in chain.DECISION[1:]:
        row = dict(log.rows[0]) | {field: "other"}
        assert chain.digest(row["prev_hash"], row, chain.DECISION) != row["hash"]
    rows = [(r["seq"], r["prev_hash"], r["hash"], "\n".join(chain._text(r[f]) for f in chain.DECISION)) for r in log.rows]
    frame = lambda rs: chain.verify_chain(spark.createDataFrame(rs, "seq long, prev_hash string, hash string, body string"), F.col("body"), chain.GENESIS["decisions"]).first()
    assert tuple(frame(rows)) == (5, None) and tuple(frame(rows[:1] + rows[2:])) == (4, 3) and tuple(frame([*rows[:3], (4, *rows[3][1:3], "x"), rows[4]])) == (5, 4)


def test_decision_chain_is_whole(spark):
    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/events.parquet").count()
    assert tuple(catalog.decision_chain(spark, d).first()) == (n, None)
    log = catalog._event_log(spark, d)
    rows = log.orderBy("seq").collect()
    again = chain.ChainLog("decisions")
    assert rows[0]["prev_hash"] == again.genesis and all(b["prev_hash"] == a["hash"] for a, b in zip(rows, rows[1:], strict=False)) and [r["seq"] for r in rows] == list(range(1, n + 1))
    verify = lambda df: tuple(chain.verify_chain(df, F.col("body"), again.genesis).first())
    at = lambda k: F.col("seq") == k
    assert verify(log.withColumn("body", F.when(at(n), "x").otherwise(F.col("body")))) == (n, n)
    assert verify(log.withColumn("prev_hash", F.when(at(n - 300), "x").otherwise(F.col("prev_hash"))).withColumn("body", F.when(at(n - 100), "x").otherwise(F.col("body")))) == (n, n - 300)
    assert verify(log.where(~at(n - 200))) == (n - 1, n - 199)


def test_aml_files(spark, tmp_path):
    head = "Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering\n"
    a, b = "2022/09/01 00:08,011,8000,001,9000,3.10,Euro,3.10,Euro,ACH,1\n", "2022/09/01 00:09,000,8001,2,9001,4.00,Euro,4.00,Euro,Wire,0\n"
    (tmp_path / "t.csv").write_text(head + a + b + a)
    txns = aml.read_transactions(spark, str(tmp_path / "t.csv"))
    rows = txns.orderBy("txn_id").collect()
    assert [(r["txn_id"], r["from_bank"], r["is_laundering"]) for r in rows] == [(1, "11", True), (2, "0", False), (3, "11", True)]
    (tmp_path / "p.txt").write_text("noise\nBEGIN LAUNDERING ATTEMPT - FAN-OUT:  Max 2\n" + a + "\nEND LAUNDERING ATTEMPT - FAN-OUT\nBEGIN LAUNDERING ATTEMPT - CYCLE\n" + b + a + "END LAUNDERING ATTEMPT\n" + b)
    patterns, lines = aml.read_patterns(spark, str(tmp_path / "p.txt"))
    assert sorted((r["pattern_id"], r["typology"], r["txn_count"]) for r in patterns.collect()) == [(1, "FAN-OUT", 1), (2, "CYCLE", 2)]
    linked, quoted = aml.link_patterns(txns, lines)
    assert {r["txn_id"]: r["pattern_id"] for r in linked.collect()} == {1: 1, 2: 2, 3: 1} and quoted.where("matched_txn_id IS NULL").count() == 0
    assert aml.as_ledger(linked, patterns).orderBy("txn_id").first()["src"] == "11|8000" and aml.report(linked).first()["labelled"] == 3
    (tmp_path / "bad.csv").write_text(head + "1,2,3\n")
    with pytest.raises(PySparkException):
        aml.read_transactions(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "a.csv").write_text("Bank Name,Bank ID,Account Number,Entity ID,Entity Name\nX,01,5,E1,One\nY,1,5,E2,Two\n")
    assert [r["entity_id"] for r in aml.read_accounts(spark, str(tmp_path / "a.csv")).collect()] == ["E1"]


def test_aml_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('h\n"X, Inc",01,5,"E1","One ""1"", Ltd"\nY,2,6,E2,\n')
    got = aml.read_accounts(spark, str(tmp_path / "a.csv")).orderBy("bank_id").collect()
    assert [tuple(r) for r in got] == [("1", "5", "X, Inc", "E1", 'One "1", Ltd'), ("2", "6", "Y", "E2", None)]
    (tmp_path / "t.csv").write_text('h\n2022/09/01 00:20,11,8000,11,"80,01",5.00,US Dollar,5.00,US Dollar,"Cheque, paper",1\n')
    r = aml.read_transactions(spark, str(tmp_path / "t.csv")).first()
    assert (r["to_account"], str(r["amount_paid"]), r["payment_format"], r["is_laundering"]) == ("80,01", "5.00", "Cheque, paper", True)


def test_card_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("TransactionID,isFraud,TransactionDT,TransactionAmt,card1,card2,C1,C3,M1,V339\n7,1,86400,68.5,13926,404.0,1.0,,T,2.5\n")
    r = cardfiles.read_transactions(spark, str(tmp_path / "t.csv")).first()
    assert (r["transaction_id"], r["is_fraud"], str(r["transaction_amt"]), r["card2"], r["addr1"]) == (7, True, "68.500", 404, None)
    assert (len(r["c_counts"]), r["c_counts"][:3], r["m_flags"][0], r["v_features"][338]) == (14, [1.0, None, None], "T", 2.5)
    (tmp_path / "i.csv").write_text("TransactionID,id_01,id_12,DeviceType\n7,-5.0,NotFound,mobile\n")
    r = cardfiles.read_identities(spark, str(tmp_path / "i.csv")).first()
    assert (r["id_01"], r["id_12"], r["id_38"], r["device_type"]) == (-5.0, "NotFound", None, "mobile")


def test_cards_with_identities(spark, tmp_path):
    (tmp_path / "t.csv").write_text("TransactionID,isFraud,TransactionDT,TransactionAmt,card1,addr1,D1\n" + "".join(f"{i},0,86400,1,{c},9,0\n" for i, c in ((1, 5), (2, 6), (3, 7), (4, 5))))
    (tmp_path / "i.csv").write_text("TransactionID,id_30,id_31,id_33,DeviceInfo\n1,os,web,,Box\n2,os,web,,Box\n3,os,,,Box\n")
    joined = cardfiles.cards(cardfiles.read_transactions(spark, str(tmp_path / "t.csv")), cardfiles.read_identities(spark, str(tmp_path / "i.csv")))
    assert {r["transaction_id"]: r["device"] for r in joined.collect()} == {1: "Box|os|web|", 2: "Box|os|web|", 3: None, 4: None}
    groups = entity.link_groups(entity.memberships(entity.resolve(joined))).collect()
    assert [(r["rule"], r["value"], r["members"]) for r in groups] == [("device_fingerprint", "Box|os|web|", 2)]


def test_env(tmp_path):
    (tmp_path / ".env").write_text("# c\nA='1'\nB=2\n\nbad\n")
    got = {"B": "x"}
    assert env.load_env(str(tmp_path / ".env"), got) == {"A": "1"} and got == {"A": "1", "B": "x"} and env.load_env(str(tmp_path / "none"), {}) == {}


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(0)
    rows = [(i, float(i), rng.randrange(30), rng.randrange(30), 9) for i in range(1, 120)]
    led = ledger(spark, rows).withColumn("ts", F.timestamp_micros("ts_us"))
    led.drop("ts_us", "typology").write.parquet(str(tmp_path / "in"))
    (tmp_path / "late").mkdir()
    cfg = Detector(formats=None, window_hours=24, stride_hours=24)
    seen = []
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = closures.detect_stream(stream, cfg, lambda found, members, no: seen.extend(r["txn_ids"] for r in found.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    from ledgerloom.operators import detect

    # The stream's windows start at midnight of the epoch, so the batch does too; its last window is still open.
    closed = ledger(spark, [(0, 0.0, "x", "y", 9), *rows])
    want = [r["txn_ids"] for r in detect.candidates(closed, cfg)[0].where("w < 4").collect()]
    assert sorted(seen) == sorted(want)
