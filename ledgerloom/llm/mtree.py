"""Exact top-k by inner product with a forest of M-trees.

Vectors are lifted by one component, sqrt(M - |x|^2) with M the largest squared norm, so that all have the same norm; a
query gets 0 there. Euclidean distance then orders candidates exactly as the inner product does, and it is a metric.

The forest is dealt by distance. At most ``CELLS`` routing vectors, one for about ``SHARD`` vectors, are its upper level:
of the ``4 * CELLS`` vectors of smallest hash at most, each is the one farthest from those before it. Every vector goes to the cell of the nearest one, and a cell has a covering radius. A cell
of more than ``SHARD`` vectors is cut into parts. Every part becomes an M-tree whose nodes are pages of at most ``PAGE``
entries. An entry of an inner page has a routing vector, a covering radius, the distance to its parent and a child page;
an entry of a leaf has the vector, its id and the distance to its parent. Pages are rows of a table in the shared folder.

A query first searches its own cell, which gives it a k-th score, and then those cells alone whose ball reaches that
score. It goes through a tree best first, by the least distance that a page's ball allows; entries are passed over without
computing a distance where the stored parent distance and the triangle inequality rule them out; the rest are compared.
Bounds carry a slack for rounding and only ever admit too much; scores are exact integers, so results are exact, ties
going to smaller ids. How much the bounds save depends on the vectors: ``comparisons`` counts it. Queries travel to the
cells that they need, trees to the blocks of ``QUERIES`` queries that ask them.

Cases: rows with a null vector, or a null or non-finite component, take no part; vectors of unequal length are compared as
if padded with zeros; rows that share a query's id are its own and aren't its candidates; queries that repeat id and
vector are asked once; a null id is no query and no candidate; an empty table gives an empty result; vectors whose scaled
squared norm reaches 2**53, where scores would not be exact, raise; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.runtime import materialise, ready

SHARD, CELLS, PAGE, QUERIES, SLACK = 8192, 4096, 256, 2048, 1e-7
#: Rows whose distances to all routing vectors are held at once.
ROUTED = 512


class Tree:
    """Pages of one shard. ``vectors`` are whole numbers; ``lift`` is their extra component."""

    def __init__(self):
        self.pages: list[dict] = []

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, most: float, page: int = PAGE, centre: np.ndarray | None = None) -> Tree:
        """``centre`` is the routing vector that the root page's entries keep their distance to, if there is one."""
        tree = cls()
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], vectors[order].astype(np.float64)
        lifted = np.concatenate([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(1)))[:, None]], axis=1)
        if centre is not None:
            centre = np.append(centre, math.sqrt(max(0.0, most - float(centre @ centre))))
        tree._grow(np.arange(len(ids)), centre, ids, x, lifted, page)
        return tree

    def _grow(self, rows, centre, ids, x, lifted, page) -> tuple[int, float]:
        """Add the page of these rows; its number and covering radius around ``centre``."""
        mine = len(self.pages)
        self.pages.append({})
        far = lambda r: np.sqrt(((lifted[r] - centre) ** 2).sum(1)) if centre is not None else np.zeros(len(r))
        if len(rows) <= page:
            parent = far(rows)
            self.pages[mine] = {"leaf": True, "keys": ids[rows], "parent": parent, "radius": np.zeros(len(rows)), "vectors": x[rows]}
            return mine, float(parent.max(initial=0.0))
        n = min(page, -(-len(rows) // page) * 2)
        seeds = rows[np.linspace(0, len(rows) - 1, n).astype(int)]
        near = np.argmin((lifted[seeds] ** 2).sum(1)[None, :] - 2 * lifted[rows] @ lifted[seeds].T, axis=1)
        if np.bincount(near).max() == len(rows):  # alike vectors: any split is as good
            near = np.arange(len(rows)) * n // len(rows)
        keys, radii, used = [], [], []
        for k in range(n):
            inside = rows[near == k]
            if len(inside):
                child, radius = self._grow(inside, lifted[seeds[k]], ids, x, lifted, page)
                keys.append(child)
                radii.append(radius)
                used.append(seeds[k])
        used = np.array(used)
        parent, radii = far(used), np.array(radii)
        self.pages[mine] = {"leaf": False, "keys": np.array(keys, np.int64), "parent": parent, "radius": radii, "vectors": x[used]}
        return mine, float(far(rows).max(initial=0.0))

    def search(self, query: np.ndarray, own: int, k: int, most: float, floor: int | None = None, centre: np.ndarray | None = None) -> tuple[list[tuple[int, int]], int]:
        """The best k (score, id), best first, and how many vectors were compared; scores below ``floor`` may be left out.

        ``centre`` is the one that the tree was built around."""
        q = query.astype(np.float64)
        base = float(q @ q) + most
        slack = SLACK * (1 + math.sqrt(base))
        best: list[tuple[int, int]] = []  # heap of (score, -id), the worst on top
        reach, compared = math.inf if floor is None else math.sqrt(max(0.0, base - 2.0 * floor)), 0
        around = None if centre is None else math.sqrt(max(0.0, base - 2.0 * float(q @ centre)))
        heap = [(0.0, 0, around)]
        while heap:
            least, at, apart_from = heapq.heappop(heap)
            if least > reach + slack:
                break
            p = self.pages[at]
            vectors, keys, radius = p["vectors"], p["keys"], p["radius"]
            if apart_from is not None:
                near = np.abs(apart_from - p["parent"]) - radius <= reach + slack
                if not near.all():
                    if not near.any():
                        continue
                    vectors, keys, radius = vectors[near], keys[near], radius[near]
            products = vectors @ q
            compared += len(keys)
            if p["leaf"]:
                least_score = best[0][0] if len(best) == k else floor
                if least_score is not None:
                    worth = np.nonzero(products >= least_score)[0]
                    if not len(worth):
                        continue
                    products, keys = products[worth], keys[worth]
                for s, i in zip(products.astype(np.int64).tolist(), keys.tolist(), strict=True):
                    if i != own:
                        if len(best) < k:
                            heapq.heappush(best, (s, -i))
                        elif (s, -i) > best[0]:
                            heapq.heapreplace(best, (s, -i))
                if len(best) == k:
                    reach = min(reach, math.sqrt(max(0.0, base - 2.0 * best[0][0])))
            else:
                apart = np.sqrt(np.maximum(0.0, base - 2.0 * products))
                for d, r, child in zip(apart.tolist(), radius.tolist(), keys.tolist(), strict=True):
                    if d - r <= reach + slack:
                        heapq.heappush(heap, (max(least, d - r), child, d))
        return [(s, -i) for s, i in sorted(best, reverse=True)], compared


def scaled(rows: DataFrame, id_col: str, vector_col: str, factor: int) -> DataFrame:
    """(id, v) of the rows that take part; v is floor(factor * x) of every component."""
    x, i = F.col(f"`{vector_col}`").cast("array<double>"), F.col(f"`{id_col}`").cast("long")
    fine = x.isNotNull() & i.isNotNull() & F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")))
    return rows.where(fine).select(i.alias("id"), F.transform(x, lambda a: F.floor(a * factor).cast("long")).alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    sizes, values = np.diff(flat.offsets.to_numpy()), flat.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), values.dtype)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


_PAGES = "cell int, part int, page int, leaf boolean, keys array<bigint>, parent array<double>, radius array<double>, vectors binary"


@dataclass(frozen=True)
class Routes:
    """The forest's upper level: routing vectors, cells that hold vectors, and their covering radii."""

    vectors: np.ndarray
    most: float
    radii: np.ndarray | None = None

    def products(self, x: np.ndarray) -> np.ndarray:
        return x @ self.vectors.T

    def to_members(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest routing vector of every vector, and its distance, all of them lifted."""
        lift = lambda v: np.sqrt(np.maximum(0.0, self.most - (v * v).sum(1)))
        products = self.products(x) + lift(x)[:, None] * lift(self.vectors)
        cell = products.argmax(1)
        return cell, np.sqrt(np.maximum(0.0, 2 * (self.most - products[np.arange(len(x)), cell])))

    def to_query(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell with the nearest routing vector of every query, and the least distance from every query to a vector of
        every cell, infinite where a cell is empty."""
        base = (q * q).sum(1)[:, None] + self.most
        apart = np.sqrt(np.maximum(0.0, base - 2 * self.products(q)))
        return np.where(np.isfinite(self.radii), apart, np.inf).argmin(1), apart - self.radii


def _spread(x: np.ndarray, n: int, most: float) -> np.ndarray:
    """At most ``n`` of the vectors: the first, then always the one farthest from all taken before, while any is apart from them."""
    lifted = np.concatenate([x, np.sqrt(np.maximum(0.0, most - (x * x).sum(1)))[:, None]], axis=1)
    taken, apart = [0], ((lifted - lifted[0]) ** 2).sum(1)
    while len(taken) < n and apart.max() > 0:
        taken.append(int(apart.argmax()))
        apart = np.minimum(apart, ((lifted - lifted[taken[-1]]) ** 2).sum(1))
    return x[taken]


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in (whole.slice(at, ROUTED) for whole in batches for at in range(0, whole.num_rows, ROUTED)):
        yield b, _matrix(pa.chunked_array([b.column("v")]), width).astype(np.float64)


def dealt(vectors: DataFrame, routes: Routes, width: int) -> DataFrame:
    """The vectors (id, v, cell, far), in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _slices(batches, width):
            cell, far = routes.to_members(x)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cell, pa.int32()), pa.array(far)], names=["id", "v", "cell", "far"])

    return materialise(vectors.mapInArrow(run, "id long, v array<bigint>, cell int, far double"), "vectors")


def build_forest(placed: DataFrame, parts: DataFrame, routes: Routes, width: int, page: int = PAGE) -> DataFrame:
    """The page table of all trees, in the shared folder; ``parts`` has a row (cell, parts) a cell."""

    def grow(group: pa.Table) -> pa.Table:
        cell = group.column("cell")[0].as_py()
        tree = Tree.build(group.column("id").to_numpy(), _matrix(group.column("v"), width), routes.most, page, routes.vectors[cell])
        cell, part = group.column("cell")[0].as_py(), group.column("part")[0].as_py()
        rows = [{"cell": cell, "part": part, "page": i, "leaf": p["leaf"], "keys": p["keys"].tolist(), "parent": p["parent"].tolist(), "radius": p["radius"].tolist(), "vectors": p["vectors"].tobytes()} for i, p in enumerate(tree.pages)]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary()]
        return pa.Table.from_pylist(rows, pa.schema(list(zip(rows[0], kinds, strict=True))))

    # At most CELLS rows.
    split = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int"))
    return materialise(split.groupBy("cell", "part").applyInArrow(grow, _PAGES), "mtree")


def _asked(pages: DataFrame, asked: DataFrame, parts: DataFrame, routes: Routes, k: int, width: int, query_block: int) -> DataFrame:
    """Rows (key, query_id, id, score, compared): what every tree of its cell finds for every query (key, id, v, cell, floor).

    A tree that finds nothing gives a row with a null id; ``compared`` stands in the first row of a query and a tree."""

    def search(trees: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if trees.num_rows and queries.num_rows:
            tree, centre = Tree(), routes.vectors[trees.column("cell")[0].as_py()]
            tree.pages = [{}] * trees.num_rows
            for r in trees.to_pylist():
                tree.pages[r["page"]] = {"leaf": r["leaf"], "keys": np.array(r["keys"], np.int64), "parent": np.array(r["parent"]), "radius": np.array(r["radius"]), "vectors": np.frombuffer(r["vectors"]).reshape(len(r["keys"]), width)}
            for key, own, floor, q in zip(*(queries.column(c).to_pylist() for c in ("key", "id", "floor")), _matrix(queries.column("v"), width), strict=True):
                found, compared = tree.search(q, own, k, routes.most, floor, centre)
                out += [(key, own, i, s, compared if n == 0 else 0) for n, (s, i) in enumerate(found)] or [(key, own, None, None, compared)]
        columns = list(zip(*out, strict=True)) or [[], [], [], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["key", "query_id", "id", "score", "compared"])

    asked = materialise(asked, "asked")
    blocks = asked.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(query_block)).cast("int").alias("blocks")).join(F.broadcast(parts), "cell")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = pages.join(F.broadcast(blocks.select("cell", "blocks")), "cell").withColumn("block", upto("blocks")).drop("blocks")
    right = asked.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod("key", F.col("blocks")).cast("int")).withColumn("part", upto("parts")).drop("blocks", "parts")
    found = left.groupBy("cell", "part", "block").cogroup(right.groupBy("cell", "part", "block")).applyInArrow(search, "key long, query_id long, id long, score long, compared long")
    return materialise(found, "found")


def _found(rows: DataFrame, is_query: Column, k: int, id_col: str, vector_col: str, factor: int, shard_size: int, query_block: int) -> tuple[DataFrame | None, int]:
    """What all trees find for all queries, and the number of vectors; nothing where there are no vectors."""
    ready(rows.sparkSession)
    vectors = scaled(rows, id_col, vector_col, factor)
    norm = F.aggregate("v", F.lit(0).cast("double"), lambda a, b: a + b.cast("double") * b.cast("double"))
    facts = vectors.agg(F.count("*").alias("n"), F.max(norm).alias("most"), F.max(F.size("v")).alias("width")).first()
    n, width, most = facts["n"], facts["width"] or 0, float(facts["most"] or 0.0)
    if most >= 2**53:
        raise OverflowError(f"a scaled vector's squared norm is {most:.3g}; from 2**53 on, scores would not be exact")
    if not n:
        return None, 0
    cells = min(CELLS, math.ceil(n / shard_size))
    drawn = vectors.select("v", F.xxhash64("id", "v").alias("h")).orderBy("h", "v").limit(4 * cells).select("v").toArrow()  # 4 * CELLS vectors at most
    routes = Routes(_spread(_matrix(drawn.column("v"), width).astype(np.float64), cells, most), most)
    placed = dealt(vectors, routes, width)
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()  # at most CELLS rows
    parts = rows.sparkSession.createDataFrame([(r["cell"], math.ceil(r["n"] / shard_size)) for r in sizes], "cell int, parts int")
    radii = np.full(len(routes.vectors), -np.inf)
    radii[[r["cell"] for r in sizes]] = [r["radius"] for r in sizes]
    routes = Routes(routes.vectors, most, radii)
    pages = build_forest(placed, parts, routes, width)
    asked = materialise(scaled(rows.where(is_query), id_col, vector_col, factor).dropDuplicates().withColumn("key", F.xxhash64("id", "v")), "queries")

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, q in _slices(batches, width):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(routes.to_query(q)[0], pa.int32()), pa.nulls(b.num_rows, pa.int64())], names=[*b.schema.names, "cell", "floor"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, q in _slices(batches, width):
            base = (q * q).sum(1) + most
            floor = b.column("floor").to_pandas().to_numpy(float)  # not a number where a query has fewer than k so far
            reach = np.where(np.isnan(floor), np.inf, np.sqrt(np.maximum(0.0, base - 2 * np.nan_to_num(floor))))
            home, least = routes.to_query(q)
            admitted = np.isfinite(least) & (least <= (reach + SLACK * (1 + np.sqrt(base)))[:, None])
            admitted[np.arange(len(q)), home] = False
            at, cell = np.nonzero(admitted)
            kept = b.select(["id", "v", "key"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cell, pa.int32()), b.column("floor").take(pa.array(at))], names=["id", "v", "key", "cell", "floor"])

    schema = "id long, v array<bigint>, key long, cell int, floor long"
    near = _asked(pages, asked.mapInArrow(at_home, schema), parts, routes, k, width, query_block)
    best = near.where("id IS NOT NULL").withColumn("r", F.row_number().over(_best())).where(F.col("r") == k).select("key", F.col("score").alias("floor"))
    wide = asked.join(best, "key", "left").select("id", "v", "key", "floor").mapInArrow(others, schema)
    return near.unionByName(_asked(pages, wide, parts, routes, k, width, query_block)), n


def _best():
    return Window.partitionBy("key").orderBy(F.col("score").desc(), "id")


def top_k(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 256, shard_size: int = SHARD, query_block: int = QUERIES) -> DataFrame:
    """Rows (query_id, rank, id, score): each query's k highest integer inner products among all other rows."""
    found, n = _found(rows, is_query, k, id_col, vector_col, factor, shard_size, query_block)
    if not n:
        return rows.sparkSession.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long")
    ranked = found.where("id IS NOT NULL").withColumn("rank", F.row_number().over(_best())).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def comparisons(rows: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", factor: int = 256, shard_size: int = SHARD, query_block: int = QUERIES) -> DataFrame:
    """One row (queries, vectors, compared, share): vectors compared, routing vectors of pages included, against all pairs."""
    found, n = _found(rows, is_query, k, id_col, vector_col, factor, shard_size, query_block)
    if not n:
        return rows.sparkSession.createDataFrame([(0, 0, 0, 0.0)], "queries long, vectors long, compared long, share double")
    total = found.agg(F.countDistinct("key").alias("queries"), F.lit(n).cast("long").alias("vectors"), F.sum("compared").alias("compared"))
    return total.withColumn("share", F.col("compared") / (F.col("queries") * F.col("vectors")))
