"""N-gram Jaccard join: documents whose sets of five-word shingles overlap by 80 % of their union.

The overlaps are entries of a sparse matrix product, document by n-gram incidence times its transpose, computed in blocks
and only where an entry can reach its bound. Sets that are equal are one class, so a group of copies is one row of the
matrix. The steps:

1. One pass over the texts gives every document's class (a hash of its set) and set size, and counts the shingles that
   are frequent within a stretch of documents. The ``ORDER`` most frequent of them order all shingles: others first, by
   hash, then these, rarest first. Any order gives the same result; this one keeps common passages out of the prefixes.
2. A second pass gives every class's prefix: if n is its size, the first n - ceil(0.8 n) + 1 shingles of that order. Two
   linked sets share a shingle of their prefixes. Prefix entries meet by shingle, frequent shingles in as many parts as
   their count asks for; a posting streams through, and only its entries with company stay.
3. Every member of a posting is paired with the posting's most central one, that with the fewest rarer shingles, if their
   sizes and the positions of the shared shingle allow the bound. Those pairs' overlaps are computed, and linked pairs joined to components.
4. Members of a posting that are still in different components are paired with each other under the same bounds, so no
   link between components goes unseen; their overlaps are computed too and the components joined again.

Overlaps are computed in blocks: rows of the incidence of a run of pairs that share their left set against that set,
accumulated per pair, pairs below their size-derived bound discarded. Sets travel only for classes in a pair: the pass
that makes them drops others by a bit filter of fixed size, whose false hits cost bytes and no result.

``every_link`` in ``linked_pairs`` skips the shortcut of step 4 and pairs all members, which yields every link between
different sets; the components are the same.

Words are runs of anything but ASCII white space, A to Z lower-cased. A text of one to four words has one shingle, all its
words. Shingles and sets are known by 64-bit hashes.

Cases: null texts and texts without a word have no shingle and no link, their component is their own id; rows with a null
id take part, and a component's id is the least that isn't null; repeated rows are linked; texts are read whole; an empty
table gives an empty result; other columns are not read, or carried by ``drop_near_copies`` under their own names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.runtime import SLICE, caches, enter, materialise, ready, text_or_empty
from ledgerloom.operators.components import components

WIDTH, ORDER, STRETCH, FREQUENT, PART = 5, 1_000_000, 4_000_000, 2, 4096
#: Fixed odd multipliers, one a place in the shingle.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_NONE = np.zeros(0, np.uint64)


#: A word's hash is the sum of its bytes' values times powers of _BASE, by place in the word, modulo 2**64.
_BASE = 0x9FB21C651E98DF25
_VALUES = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
_IS_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of every word of a stretch of bytes that starts and ends with white space."""
    space = _IS_SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    first, last = edges[::2], edges[1::2]
    room = 1 << max(20, len(data).bit_length())
    terms = _VALUES[data]
    terms *= _powers(_BASE, room)[: len(data)]
    terms[space] = 0
    sums = np.cumsum(terms, dtype=np.uint64)
    return first, (sums[last - 1] - sums[first - 1]) * _powers(pow(_BASE, -1, 1 << 64), room)[first]


def _stretches(texts: list[bytes], most: int = 1_000_000) -> Iterator[list[bytes]]:
    """Runs of texts of about so many bytes; a longer text is alone."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > most:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    return [s for part in _stretches(texts) for s in _shingle_sets(part)]


def _shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b"\n".join([b"", *texts, b""]).lower(), np.uint8)
    starts, flat = _word_hashes(data)
    bounds = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)])).tolist()
    n = len(flat) - WIDTH + 1
    if n > 0:
        grams = flat[:n] * _PLACES[0]
        for k in range(1, WIDTH):
            grams ^= grams >> np.uint64(29)
            grams += flat[k : n + k] * _PLACES[k]
        grams ^= grams >> np.uint64(32)
        grams *= _PLACES[1]
        grams ^= grams >> np.uint64(29)
    out = []
    for text, at, end in zip(texts, bounds[:-1], bounds[1:], strict=True):
        size = end - at
        if size >= WIDTH:
            one = np.sort(grams[at : end - WIDTH + 1])
            fresh = np.empty(len(one), bool)
            fresh[0] = True
            np.not_equal(one[1:], one[:-1], out=fresh[1:])
            out.append(one if fresh.all() else one[fresh])
        elif size:
            out.append(np.array([xxhash.xxh3_64_intdigest(b" ".join(text.lower().split()), seed=size)], np.uint64))
        else:
            out.append(_NONE)
    return out


caches("jaccard", _powers.cache_clear)


def class_of(shingles: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(shingles.tobytes()), "big", signed=True)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _first_seen(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[int, np.ndarray]]:
    """Classes with their sets, each once a task; sets without shingles are left out."""
    enter("jaccard")
    seen: set[int] = set()
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            for s in shingle_sets(b.column(column).slice(at, SLICE).to_pylist()):
                if len(s) and (c := class_of(s)) not in seen:
                    seen.add(c)
                    yield c, s


def classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Step 1: (doc_id, cid, n) of every document, and (h, n) of frequent shingles."""
    ready(docs.sparkSession)
    thin = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kind", "a", "b", "n"]

        def frequent(used: int) -> pa.RecordBatch:
            part = stretch[:used]
            part.sort()
            h, n = np.unique(part[1:][part[1:] == part[:-1]], return_counts=True)  # every occurrence but a shingle's first
            often = n + 1 >= FREQUENT
            h, n = h[often], n[often] + 1
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(h), np.int32)), pa.nulls(len(h), pa.int64()), _signed(h), pa.array(n)], names=names)

        enter("jaccard")
        stretch, size, seen = np.empty(STRETCH, np.uint64), 0, set()
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                sets = shingle_sets(part.column(1).to_pylist())
                cids = [class_of(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), part.column(0), pa.array(cids, pa.int64()), pa.array([len(s) for s in sets], pa.int64())], names=names)
                for c, s in zip(cids, sets, strict=True):
                    if c is not None and c not in seen:
                        seen.add(c)
                        while len(s):
                            room = min(len(s), STRETCH - size)
                            stretch[size : size + room] = s[:room]
                            s, size = s[room:], size + room
                            if size == STRETCH:
                                yield frequent(size)
                                size = 0
        yield frequent(size)

    made = materialise(thin.mapInArrow(run, "kind int, a long, b long, n long"), "classes")
    return made.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("cid"), "n"), made.where("kind = 1").select(F.col("b").alias("h"), "n")


def _least_overlap(n):
    """ceil(0.8 n)."""
    return (4 * n + 4) // 5


def prefixes(docs: DataFrame, frequent: DataFrame, text_col: str) -> DataFrame:
    """Step 2, first half: (h, part, parts, cid, n, pos) of every class's prefix."""
    top = frequent.groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "h").limit(ORDER).toArrow()
    h, n = top.column("h").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(h)
    known = docs.sparkSession.sparkContext.broadcast((h[order], n[order]))  # ORDER rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = known.value
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def rows() -> pa.RecordBatch:
            c = [np.concatenate(x) for x in zip(*held, strict=True)]
            return pa.RecordBatch.from_arrays([_signed(c[0]), *(pa.array(x) for x in c[1:])], names=["h", "part", "parts", "cid", "n", "pos"])

        for cid, s in _first_seen(batches, 0):
            weight = np.zeros(len(s), np.int64)
            if len(often):
                at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                weight = np.where(often[at] == s, times[at], 0)
            keep = len(s) - _least_overlap(len(s)) + 1
            picked = np.argsort(weight, kind="stable")[:keep]  # sets are sorted by hash
            parts = (weight[picked] // PART + 1).astype(np.int32)
            part = ((cid & 0x7FFFFFFF) % parts).astype(np.int32)
            held.append((s[picked], part, parts, np.full(keep, cid), np.full(keep, len(s), np.int32), np.arange(keep, dtype=np.int32)))
            size += keep
            if size > 50_000:
                yield rows()
                held, size = [], 0
        if held:
            yield rows()

    return docs.select(text_or_empty(text_col).cast("binary").alias("text")).mapInArrow(run, "h long, part int, parts int, cid long, n int, pos int")


_POSTINGS = "h long, cid long, n int, pos int, pcid long, pn int, ppos int"


def postings(entries: DataFrame) -> DataFrame:
    """Step 2, second half: the entries that have company, each with the most central of its part of the posting."""
    spark = entries.sparkSession
    dealt = entries.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "h", "part").sortWithinPartitions("h", "part", "pos", "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: list[np.ndarray] | None = None  # the last entry so far, held back until it is known whether it has company
        lone = False  # whether that entry opens its run
        first: list[np.ndarray] | None = None  # first of the run that is open
        for b in batches:
            cols = [b.column(i).to_numpy() for i in range(6)]
            if tail is not None:
                cols = [np.concatenate([t, c]) for t, c in zip(tail, cols, strict=True)]
            h, part, parts, cid, n, pos = cols
            fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (part[1:] != part[:-1])])
            same = np.concatenate([[False], (cid[1:] == cid[:-1])]) & ~fresh
            if tail is not None:
                fresh[0] = lone
            keep = ~same
            cols, fresh = [c[keep] for c in cols], fresh[keep]
            h, part, parts, cid, n, pos = cols
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), -1))
            pivot = [np.where(start >= 0, c[np.maximum(start, 0)], first[i] if first is not None else 0) for i, c in ((0, cid), (1, n), (2, pos))]
            after = np.concatenate([~fresh[1:], [False]])
            company = ~fresh | after | (parts > 1)
            company[-1] = False
            done = [c[company] for c in (h, cid, n, pos, *pivot)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in done], names=[x.split()[0] for x in _POSTINGS.split(", ")])
            tail, lone = [c[-1:] for c in cols], bool(fresh[-1])
            first = [p[-1] for p in pivot]
        if tail is not None and (not lone or tail[2][0] > 1):
            h, part, parts, cid, n, pos = tail
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h, cid, n, pos, *(np.array([f], k) for f, k in zip(first, ("i8", "i4", "i4"), strict=True)))], names=[x.split()[0] for x in _POSTINGS.split(", ")])

    return materialise(dealt.mapInArrow(run, _POSTINGS), "postings")


def _may_link(n1: str, p1: str, n2: str, p2: str):
    """Whether sets of these sizes that first share these positions can reach the bound: 180 times the overlap >= 80 times both sizes."""
    rest = f"1 + least({n1} - {p1}, {n2} - {p2}) - 1"
    return F.expr(f"least({n1}, {n2}) * 5L >= greatest({n1}, {n2}) * 4L AND 9L * ({rest}) >= 4L * ({n1} + {n2})")


def _needed_sets(docs: DataFrame, text_col: str, needed: DataFrame) -> DataFrame:
    """(cid, s) of at least the needed classes: sets as packed 64-bit hashes, from another pass over the texts."""
    spark = docs.sparkSession
    m = needed.count()
    words = 1 << max(10, min(21, (4 * m).bit_length()))  # of 64 bits, at least 256 bits a class up to 16 MB in all
    bits = needed.groupBy(F.col("cid").bitwiseAND(F.lit(64 * words - 1)).alias("at")).agg(F.count("*")).groupBy(F.shiftrightunsigned("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(words, np.int64)
    table[bits.column("word").to_numpy()] = bits.column("bits").to_numpy()
    known = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, held, size = known.value, [], 0
        for cid, s in _first_seen(batches, 0):
            at = cid & (64 * words - 1)
            if int(flags[at >> 6]) >> (at & 63) & 1:
                held.append((cid, s.tobytes()))
                size += 8 * len(s)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in held], pa.int64()), pa.array([x for _, x in held], pa.binary())], names=["cid", "s"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in held], pa.int64()), pa.array([x for _, x in held], pa.binary())], names=["cid", "s"])

    made = docs.select(text_or_empty(text_col).cast("binary").alias("text")).mapInArrow(run, "cid long, s binary")
    return made.dropDuplicates(["cid"])


def overlaps(pairs: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """The pairs (a, b) that are linked, with their overlap: blocked product of the incidences."""
    both = pairs.select(F.col("a").alias("cid")).union(pairs.select(F.col("b").alias("cid"))).distinct()
    # Both joins read the one exchange that makes sets distinct: it is already dealt by class.
    sets = _needed_sets(docs, text_col, materialise(both, "needed"))
    right = pairs.join(sets.select(F.col("cid").alias("b"), F.col("s").alias("sb")), "b")
    full = right.join(sets.select(F.col("cid").alias("a"), F.col("s").alias("sa")), "a").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, out = b.column(0).to_numpy(), np.zeros(b.num_rows, np.int64)
            edges = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1], [True]])) if b.num_rows else np.zeros(1, int)
            keep = np.zeros(b.num_rows, bool)
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                row = np.frombuffer(b.column(2)[lo].as_py(), np.uint64)
                for at in range(lo, hi, 256):
                    members = [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(3)[at : min(hi, at + 256)]]
                    block, sizes = np.concatenate(members), np.array([len(x) for x in members])
                    hit = row[np.minimum(np.searchsorted(row, block), len(row) - 1)] == block
                    shared = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes) - sizes)
                    out[at : at + len(members)] = shared
                    keep[at : at + len(members)] = 180 * shared >= 80 * (sizes + len(row))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep)), pa.array(out[keep])], names=["a", "b", "overlap"])

    return materialise(full.mapInArrow(run, "a long, b long, overlap long"), "links")


def _between(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of members of the same posting that may link; rows (h, cid, n, pos, c) on both sides."""
    x, y = left.alias("x"), right.alias("y")
    bound = _may_link("x.n", "x.pos", "y.n", "y.pos")
    met = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.c") != F.col("y.c")) & bound)
    return met.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()


def linked_pairs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", every_link: bool = False) -> tuple[DataFrame, DataFrame]:
    """(doc_id, cid, n) of every document, and links (a, b, overlap) between classes: a spanning set, or with ``every_link`` all."""
    members, frequent = classes(docs, id_col, text_col)
    post = postings(prefixes(docs, frequent, text_col))
    star = post.where("cid <> pcid").where(_may_link("n", "pos", "pn", "ppos")).select(F.col("pcid").alias("a"), F.col("cid").alias("b")).distinct()
    if every_link:
        rows = post.select("h", "cid", "n", "pos", F.col("cid").alias("c"))
        return members, overlaps(materialise(_between(rows, rows), "pairs"), docs, text_col)
    tried = materialise(star, "pairs")
    links = overlaps(tried, docs, text_col)
    labels = components(links)
    c = post.join(labels.select(F.col("node").alias("cid"), "component"), "cid", "left").select("h", "cid", "n", "pos", F.coalesce("component", "cid").alias("c"))
    c = materialise(c, "labelled")
    # Postings whose members are in several components; the members outside the largest meet all others.
    each = c.groupBy("h", "c").agg(F.count("*").alias("m"))
    mixed = materialise(each.groupBy("h").agg(F.max(F.struct("m", "c"))["c"].alias("main"), F.count("*").alias("k")).where("k > 1").select("h", "main"), "mixed")
    rest = c.join(mixed, "h")
    more = _between(rest.where("c <> main").drop("main"), rest.drop("main"))
    more = more.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    more = materialise(more, "pairs")
    if not more.limit(1).count():
        return members, links
    return members, links.unionByName(overlaps(more, docs, text_col))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_shingles, component_id)."""
    members, links = linked_pairs(docs, text_col, id_col)
    least = members.where("cid IS NOT NULL").groupBy("cid").agg(F.min("doc_id").alias("least"))
    labels = components(links).select(F.col("node").alias("cid"), "component")
    named = least.join(labels, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = materialise(named.join(ids, "component").select("cid", "component_id"), "components")
    out = members.join(of, "cid", "left").withColumn("component_id", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, of each component only the row of the least id (nulls last; of rows that share
    it, one by a hash of the text, then by place); documents without shingles, and those whose component has no id, stay.

    Rows are written once with a row id, so that repeated and null ids are told apart."""
    cols = docs.columns
    carried = docs.select(F.monotonically_increasing_id().alias("rid"), *[F.col(f"`{c}`").alias(f"carry{i}") for i, c in enumerate(cols)])
    rows = materialise(carried, "rows", **{"parquet.block.size": 16 << 20})  # small row groups: texts wait in memory
    key, text = f"carry{cols.index(id_col)}", f"carry{cols.index(text_col)}"
    members, links = linked_pairs(rows, text, "rid")
    labels = components(links).select(F.col("node").alias("cid"), "component")
    place = F.struct(F.col(key).isNull().alias("nameless"), F.col(key).alias("id"), F.xxhash64(text_or_empty(text)).alias("tie"), "rid")
    own = members.where("cid IS NOT NULL").select(F.col("doc_id").alias("rid"), "cid").join(rows.select("rid", place.alias("place")), "rid")
    own = materialise(own, "places")
    named = own.groupBy("cid").agg(F.min("place").alias("least")).join(labels, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    first = named.groupBy("component").agg(F.min("least").alias("first"))
    of = materialise(named.join(first, "component").select("cid", F.col("first.nameless").alias("nameless"), F.col("first.rid").alias("stays")), "components")
    gone = own.join(of, "cid").where("NOT nameless AND rid <> stays").select("rid")
    return rows.join(gone, "rid", "left_anti").select(*[F.col(f"carry{i}").alias(c) for i, c in enumerate(cols)])
