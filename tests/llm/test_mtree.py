import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import mtree

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k=5, every=50):
    import math

    fine = [(i, [math.floor(256 * float(np.float32(a))) for a in v]) for i, v in rows if i is not None and v is not None and all(a is not None and math.isfinite(a) for a in v)]
    out = set()
    for i, q in {(i, tuple(q)) for i, q in fine if i % every == 0}:
        scored = sorted(((-sum(a * b for a, b in zip(q, x)), j) for j, x in fine if j != i))[:k]  # noqa: B905
        out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)}
    return out


@pytest.mark.parametrize("shard", [40, 10_000])
def test_search(spark, shard):
    rng = random.Random(shard)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(600)]
    rows += [(600 + i, [0.5] * 8) for i in range(300)]  # alike vectors, ties by id
    rows += [(2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 8), (2150, [float("inf")] * 8), (None, [1.0] * 8), (2200, []), (2250, [0.25, -0.5])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], SCHEMA)
    got = mtree.top_k(df, F.col("vec_id") % 50 == 0, shard_size=shard, query_block=7)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == brute(rows)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0], ""), (1, [2.0], ""), (50, [3.0], "")], SCHEMA)
    got = sorted(tuple(r) for r in mtree.top_k(df, F.col("vec_id") % 50 == 0).collect())
    assert got == [(0, 1, 50, 256 * 768), (0, 2, 1, 256 * 512), (50, 1, 1, 768 * 512), (50, 2, 0, 768 * 256)]
    assert mtree.top_k(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_pass_over_vectors():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.integers(-5, 5, (400, 4)) + 1000 * np.eye(4, dtype=int)[k] for k in range(4)])
    most = float((x * x).sum(1).max())
    tree = mtree.Tree.build(np.arange(len(x)), x, most, page=32)
    best, compared = tree.search(x[3], 3, 5, most)
    want = sorted(((int(s), -i) for i, s in enumerate(x @ x[3]) if i != 3), reverse=True)[:5]
    assert [(s, -i) for s, i in best] == want and compared < len(x) / 2


def test_cells_are_passed_over(spark):
    rng = random.Random(9)
    # Inner products tell these clusters apart: all but a query's own are at right angles to it.
    rows = [(i, [1000.0 * (b == i % 16) + rng.gauss(0, 1) for b in range(16)]) for i in range(1600)] + [(50, [1.0] * 16), (50, [900.0] + [1.0] * 15)]  # repeated ids
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], SCHEMA)
    ask = F.col("vec_id") % 50 == 0
    got = mtree.top_k(df, ask, factor=1, shard_size=100)
    flat = [(i, [x / 256 for x in v]) for i, v in ((i, [float(np.float32(x)) for x in v]) for i, v in rows)]
    want = set()
    fine = [(i, [int(np.floor(x * 256)) for x in v]) for i, v in flat]
    for i, q in {(i, tuple(q)) for i, q in fine if i % 50 == 0}:
        for r, (s, j) in enumerate(sorted(((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in fine if j != i))[:5]):
            want.add((i, r + 1, j, -s))
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == want
    cost = mtree.comparisons(df, ask, factor=1, shard_size=100).first()
    assert cost["vectors"] == len(rows) and cost["share"] < 0.3


def test_too_large_raises(spark):
    df = spark.createDataFrame([(0, [1.0, 1e30], ""), (1, [2.0, 0.0], "")], SCHEMA)
    with pytest.raises(OverflowError):
        mtree.top_k(df, F.col("vec_id") % 50 == 0)
