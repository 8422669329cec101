"""Connected components of an edge list, by alternating large-star and small-star rounds on DataFrames.

Every round only groups by a node and joins back, so a hub with a third of all edges is combined map-side in the
aggregate and split by adaptive execution in the join. Rounds are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.storage import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, left: str = "a", right: str = "b", keys: tuple[str, ...] = (), rounds: int = 50) -> DataFrame:
    """Rows (*keys, node, component) of every node that has an edge to another; component is its least node.

    With ``keys`` every combination of their values is a graph of its own. Edges with a null end are ignored; self-loops
    and repeated edges change nothing; an empty edge list gives an empty result. It raises if the last of ``rounds`` rounds
    still changed an edge.
    """
    k = [F.col(f"`{c}`") for c in keys]
    ends = [F.col(f"`{left}`"), F.col(f"`{right}`")]
    node = (lambda c: F.struct(*k, c.alias("node"))) if keys else (lambda c: c)
    now = edges.where(ends[0].isNotNull() & ends[1].isNotNull() & (ends[0] != ends[1])).select(node(ends[0]).alias("a"), node(ends[1]).alias("b"))
    now = written(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        now = written(_small_star(_large_star(now)), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    pairs = now.union(now.select(F.col("b").alias("a"), "b")).distinct()
    if keys:
        return pairs.select(*[F.col("a")[c].alias(c) for c in keys], F.col("a.node").alias("node"), F.col("b.node").alias("component"))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))


def window_components(edges: DataFrame, window: str = "w", left: str = "src", right: str = "dst", local_limit: int = 2_000_000) -> DataFrame:
    """Rows (window, node, component) of every end of an edge, self-loops included; component is its least node.

    Windows of at most ``local_limit`` edges (checked) are solved one a task over Arrow columns; if any has more, all go
    through the distributed rounds.
    """
    w, a, b = F.col(window), F.col(left), F.col(right)
    thin = edges.select(w.alias("w"), a.alias("a"), b.alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    largest = thin.groupBy("w").count().agg(F.max("count")).first()[0] or 0
    if largest > local_limit:
        nodes = thin.select("w", F.explode(F.array("a", "b")).alias("node")).distinct()
        found = components(thin, keys=("w",)).alias("f")
        out = nodes.alias("n").join(found, (F.col("n.w") == F.col("f.w")) & (F.col("n.node") == F.col("f.node")), "left")
        return out.select(F.col("n.w").alias(window), F.col("n.node").alias("node"), F.coalesce(F.col("f.component"), F.col("n.node")).alias("component"))

    def solve(group):
        import numpy as np
        import pyarrow as pa

        ends = np.concatenate([group.column("a").to_numpy(zero_copy_only=False), group.column("b").to_numpy(zero_copy_only=False)])
        names, at = np.unique(ends, return_inverse=True)
        u, v = at[: len(at) // 2], at[len(at) // 2 :]
        label = np.arange(len(names))
        while True:  # hook every edge's larger label to the smaller, then jump to the roots
            low = np.minimum(label[u], label[v])
            before = label.copy()
            np.minimum.at(label, label[u], low)
            np.minimum.at(label, label[v], low)
            while not np.array_equal(label, label[label]):
                label = label[label]
            if np.array_equal(before, label):
                break
        one = group.column("w")[0].as_py()
        return pa.table({window: pa.array([one] * len(names), group.schema.field("w").type), "node": pa.array(names), "component": pa.array(names[label])})

    kinds = dict(thin.dtypes)
    return thin.groupBy("w").applyInArrow(solve, f"`{window}` {kinds['w']}, node {kinds['a']}, component {kinds['a']}")
