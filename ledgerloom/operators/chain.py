"""Hash-chained logs of decisions and restrictions: appended by one writer, verified by a query."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.storage import written

GENESIS = {"decisions": hashlib.sha256(b"ledgerloom decisions").hexdigest(), "restrictions": hashlib.sha256(b"ledgerloom restrictions").hexdigest()}
DECISION = ["seq", "decided_at", "ring_id", "action", "proposed", "confidence", "source", "rationale", "adjustments", "evidence"]
RESTRICTION = ["seq", "event", "recorded_at", "account", "tier", "ring_id", "decision_seq", "pass", "reason", "imposed_at", "expires_at"]


def _text(x) -> str:
    if x is None:
        return ""
    if isinstance(x, datetime):
        return x.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ") if x.tzinfo else x.strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    if isinstance(x, float):
        return f"{x:.6f}"
    if isinstance(x, list | tuple):
        return f"{len(x)}" + "".join(f"\n{len(y)}:{y}" for y in x)  # with lengths, so that neighbours can't be joined unseen
    if isinstance(x, dict):
        return json.dumps(x, sort_keys=True, separators=(",", ":"))
    return str(x)


def digest(prev: str, row: dict, fields: list[str]) -> str:
    return hashlib.sha256("\n".join([prev, *(_text(row.get(f)) for f in fields)]).encode()).hexdigest()


class ChainLog:
    """An append-only log in memory of the single writer; ``rows`` go to storage as they are."""

    def __init__(self, kind: str, rows: list[dict] | None = None):
        self.fields = DECISION if kind == "decisions" else RESTRICTION
        self.genesis, self.rows = GENESIS[kind], list(rows or [])

    def append(self, **row) -> dict:
        prev = self.rows[-1]["hash"] if self.rows else self.genesis
        row = {f: row.get(f) for f in self.fields} | {"seq": (self.rows[-1]["seq"] + 1) if self.rows else 1}
        row |= {"prev_hash": prev, "hash": digest(prev, row, self.fields)}
        self.rows.append(row)
        return row

    def verify(self) -> tuple[int, int | None]:
        """How many rows there are, and the seq of the first that breaks the chain."""
        prev, broken = self.genesis, None
        for row in sorted(self.rows, key=lambda r: r["seq"]):
            if broken is None and (row["prev_hash"] != prev or row["hash"] != digest(prev, row, self.fields)):
                broken = row["seq"]
            prev = row["hash"]
        return len(self.rows), broken


def chained(rows: DataFrame, order: str, body: Column, genesis: str) -> DataFrame:
    """(seq, prev_hash, hash, body) of a log over all rows by ``order``, as its single writer appends them.

    A hash needs the one before it, so one task sorts the rows (spilling) and makes them batch by batch.
    """

    def append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev, seq = genesis, 0
        for b in batches:
            before, made = [], []
            for text in b.column(0).to_pylist():
                before.append(prev)
                prev = hashlib.sha256(f"{prev}\n{text}".encode()).hexdigest()
                made.append(prev)
            yield pa.RecordBatch.from_arrays([pa.array(range(seq + 1, seq + 1 + len(made)), pa.int64()), pa.array(before, pa.string()), pa.array(made, pa.string()), b.column(0)], names=["seq", "prev_hash", "hash", "body"])
            seq += len(made)

    texts = rows.select(F.col(order).alias("__order"), F.coalesce(body, F.lit("")).alias("body")).repartition(1).sortWithinPartitions("__order")
    return written(texts.select("body").mapInArrow(append, "seq long, prev_hash string, hash string, body string"), "log")


def verify_chain(log: DataFrame, content: Callable[[], Column] | Column, genesis: str, partition: str | None = None) -> DataFrame:
    """One row (entries, first_broken): links and contents of a log (seq, prev_hash, hash). ``content`` is the text hashed after prev_hash.

    The link of a row is checked against the row of the number before it, found by a join, so the log isn't sorted into
    one task; a missing number breaks at the row that lost its predecessor.
    """
    body = content() if callable(content) else content
    now = log.withColumn("made", F.sha2(F.concat_ws("\n", F.col("prev_hash"), body), 256))
    first = log.agg(F.min("seq").alias("first"))
    before = log.select((F.col("seq") + 1).alias("seq"), F.col("hash").alias("link"))
    rows = now.join(before, "seq", "left").join(F.broadcast(first))
    link = F.when(F.col("seq") == F.col("first"), F.lit(genesis)).otherwise(F.col("link"))
    bad = ~F.coalesce((link == F.col("prev_hash")) & (F.col("made") == F.col("hash")), F.lit(False))
    return rows.agg(F.count("*").alias("entries"), F.min(F.when(bad, F.col("seq"))).alias("first_broken"))


def orphaned_holds(active: DataFrame, first_broken: DataFrame) -> DataFrame:
    """Active restrictions authorised by a decision at or after the first broken one."""
    return active.join(F.broadcast(first_broken.select("first_broken"))).where("decision_seq >= first_broken").drop("first_broken")


def withheld(log: DataFrame) -> DataFrame:
    """(reason, n): why decisions didn't freeze, by what their adjustments say."""
    reasons = [(r, F.exists("adjustments", lambda a, r=r: a.contains(r))) for r in ("score", "confidence", "amount", "accounts")]
    return log.select(F.explode(F.array_compact(F.array(*[F.when(c, r) for r, c in reasons]))).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def recent(log: DataFrame, n: int = 20) -> DataFrame:
    return log.orderBy(F.col("seq").desc()).limit(n)


