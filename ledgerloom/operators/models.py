"""Logistic ranking model and isolation forest."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.config import Forest, Training
from ledgerloom.functions.scalars import dot, sigmoid
from ledgerloom.storage import written


@dataclass(frozen=True)
class Ranker:
    """A model bound to the names of its features; scoring is a column expression."""

    names: list[str]
    means: list[float]
    deviations: list[float]
    weights: list[float]
    bias: float

    def score(self, columns: list[Column]) -> Column:
        scaled = [(c - F.lit(m)) / F.lit(s) for c, m, s in zip(columns, self.means, self.deviations, strict=True)]
        return sigmoid(dot(scaled, self.weights, self.bias))

    def explain(self) -> list[tuple[str, float]]:
        return sorted(zip(self.names, self.weights, strict=True), key=lambda p: -abs(p[1]))


def standardize(rows: DataFrame, columns: dict[str, Column]) -> tuple[list[float], list[float]]:
    """Means and population deviations; a deviation under 1e-9 counts as 1."""
    facts = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns.values())], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns.values())]).first()
    k = range(len(columns))
    return [facts[f"m{i}"] or 0.0 for i in k], [s if (s := facts[f"s{i}"] or 0.0) >= 1e-9 else 1.0 for i in k]


def descend(x: np.ndarray, y: np.ndarray, cfg: Training = Training()) -> tuple[np.ndarray, float]:
    """Full-batch gradient descent of the weighted logistic loss; the gradient is divided by the number of rows."""
    n, pos = len(y), float(y.sum())
    w, b = np.zeros(x.shape[1]), 0.0
    if not n:
        return w, b
    heavy = cfg.positive_weight if cfg.positive_weight is not None else (n - pos) / pos if pos else 1.0
    each = np.where(y > 0, heavy, 1.0)
    for _ in range(cfg.epochs):
        z = x @ w + b
        p = np.where(z >= 0, 1 / (1 + np.exp(-np.abs(z))), np.exp(-np.abs(z)) / (1 + np.exp(-np.abs(z))))
        e = (p - y) * each
        w = w - cfg.rate * (x.T @ e / n + cfg.l2 * w)
        b -= cfg.rate * e.sum() / n
    return w, b


def train(rows: DataFrame, columns: list[Column], names: list[str], label: str, cfg: Training = Training(), most_rows: int = 2_000_000) -> Ranker:
    """Fit on labelled rows. Up to ``most_rows`` (checked) the scaled matrix is fitted on the driver; beyond, every step sums
    gradients over the cluster."""
    rows = written(rows.select(*[c.alias(n) for c, n in zip(columns, names, strict=True)], F.col(label).cast("double").alias("__y")), "train")
    columns, label = [F.col(n) for n in names], "__y"
    means, sds = standardize(rows, dict(zip(names, columns, strict=True)))
    n = rows.count()
    if n > most_rows:
        return _train_distributed(rows, columns, names, label, means, sds, n, cfg)
    got = rows.select(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)], F.col(label).cast("double").alias("y")).orderBy(*[f"x{i}" for i in range(len(columns))], "y").toArrow()
    x = np.stack([got.column(f"x{i}").to_numpy() for i in range(len(columns))], axis=1) if n else np.zeros((0, len(columns)))
    w, b = descend((x - means) / sds if n else x, got.column("y").to_numpy(), cfg)
    return Ranker(names, means, sds, [float(v) for v in w], float(b))


def _train_distributed(rows, columns, names, label, means, sds, n, cfg) -> Ranker:
    scaled = written(rows.select(*[((c - m) / s).alias(f"x{i}") for i, (c, m, s) in enumerate(zip(columns, means, sds, strict=True))], F.col(label).cast("double").alias("y")), "train")
    pos = scaled.agg(F.sum("y")).first()[0] or 0.0
    heavy = cfg.positive_weight if cfg.positive_weight is not None else (n - pos) / pos if pos else 1.0
    k, w, b = range(len(columns)), [0.0] * len(columns), 0.0
    for _ in range(cfg.epochs):
        e = (sigmoid(dot([F.col(f"x{i}") for i in k], w, b)) - F.col("y")) * F.when(F.col("y") > 0, heavy).otherwise(1.0)
        g = scaled.withColumn("e", e).agg(F.sum("e"), *[F.sum(F.col("e") * F.col(f"x{i}")) for i in k]).first()
        w = [w[i] - cfg.rate * (g[i + 1] / n + cfg.l2 * w[i]) for i in k]
        b -= cfg.rate * g[0] / n
    return Ranker(names, means, sds, w, b)


def average_path(n: int) -> float:
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def draws(n: int, cfg: Forest = Forest()) -> np.ndarray:
    """Row numbers from 0 to n - 1, drawn with replacement: a row a tree."""
    return np.random.default_rng(cfg.seed).integers(0, n, (cfg.trees, min(cfg.sample, n)))


class IsolationForest:
    """Trees over bootstrap samples; a row's score is 2 to minus its mean depth over the sample's average path.

    ``drawn`` are the places in ``x`` of every tree's sample, one row a tree, by default drawn from all of ``x``.
    """

    def __init__(self, x: np.ndarray, cfg: Forest = Forest(), drawn: np.ndarray | None = None):
        self.cfg, self.trees = cfg, []
        if not len(x):
            return
        drawn = draws(len(x), cfg) if drawn is None else drawn
        rng = np.random.default_rng((cfg.seed, 1))
        self.size = drawn.shape[1]
        self.depth = math.ceil(math.log2(self.size)) if self.size > 1 else 0
        for places in drawn:
            self.trees.append(self._grow(x[places], 0, rng))

    def _grow(self, rows: np.ndarray, depth: int, rng) -> tuple:
        low, high = (rows.min(0), rows.max(0)) if len(rows) else (None, None)
        varying = np.flatnonzero(high > low) if len(rows) > 1 else np.zeros(0, int)
        if depth >= self.depth or not len(varying):
            return (depth + average_path(len(rows)),)
        k = int(rng.choice(varying))
        cut = float(rng.uniform(low[k], high[k]))
        left = rows[:, k] < cut
        return k, cut, self._grow(rows[left], depth + 1, rng), self._grow(rows[~left], depth + 1, rng)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.trees:
            return np.zeros(len(x))
        total = np.zeros(len(x))
        for tree in self.trees:
            todo = [(tree, np.arange(len(x)))]
            while todo:
                node, rows = todo.pop()
                if len(node) == 1:
                    total[rows] += node[0]
                    continue
                left = x[rows, node[0]] < node[1]
                todo += [(node[2], rows[left]), (node[3], rows[~left])]
        return 2.0 ** (-(total / len(self.trees)) / max(average_path(self.size), 1e-12))


def bootstrap(rows: DataFrame, columns: list[Column], cfg: Forest = Forest()) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature vectors, and the places in them of every tree's sample, drawn from all rows.

    Rows are numbered in the order of their vectors: each distinct vector has a run of numbers as long as its count. Numbers
    come from a range-partitioned sort shifted by partition counts; only vectors that own a drawn number reach the driver.
    """
    names = [f"x{i}" for i in range(len(columns))]
    counted = rows.select(*[c.cast("double").alias(x) for c, x in zip(columns, names, strict=True)]).groupBy(*names).agg(F.count("*").alias("m"))
    n_parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(counted.repartitionByRange(n_parts, *names).withColumn("p", F.spark_partition_id()), "vectors")
    sizes = placed.groupBy("p").agg(F.sum("m").alias("m")).orderBy("p").collect()
    n = sum(r["m"] for r in sizes)
    if not n:
        return np.zeros((0, len(names))), np.zeros((0, 0), int)
    numbers = draws(n, cfg)
    wanted = np.unique(numbers)
    ahead = placed.sparkSession.createDataFrame([(r["p"], sum(x["m"] for x in sizes[:i])) for i, r in enumerate(sizes)], "p int, off long")
    upto = Window.partitionBy("p").orderBy(*names).rowsBetween(Window.unboundedPreceding, 0)
    ends = placed.withColumn("upto", F.sum("m").over(upto)).join(F.broadcast(ahead), "p").withColumn("end", F.col("upto") + F.col("off"))

    @F.pandas_udf("boolean")
    def drawn(end, m):
        import pandas as pd

        return pd.Series(np.searchsorted(wanted, end.to_numpy()) > np.searchsorted(wanted, (end - m).to_numpy()))

    pick = ends.where(drawn("end", "m")).select("end", *names).toArrow()
    order = np.argsort(pick.column("end").to_numpy())
    x = np.stack([pick.column(c).to_numpy()[order].astype(float) for c in names], axis=1)
    return x, np.searchsorted(pick.column("end").to_numpy()[order], numbers, side="right")


def anomaly(rows: DataFrame, train_rows: DataFrame, columns: list[Column], cfg: Forest = Forest()) -> DataFrame:
    """The rows with ``anomaly``, fitted on samples of all training rows (trees see ``sample`` each), scored over Arrow batches."""
    x, drawn = bootstrap(train_rows, columns, cfg)
    forest = IsolationForest(x, cfg, drawn)

    @F.pandas_udf("double")
    def scored(features):
        import pandas as pd

        return pd.Series(forest.score(features.to_numpy(float)))

    return rows.withColumn("anomaly", scored(F.struct(*[c.cast("double").alias(f"x{i}") for i, c in enumerate(columns)])))
