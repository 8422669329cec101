"""What the operators of this subpackage share: worker import path, shared scratch tables, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.storage import written

#: The base word of most contracts is a run of anything but these six characters.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


#: Rows that a Python worker holds as Python values at once.
SLICE = 512


#: Arrow batches of the session: long texts and packed sets make rows of many kilobytes.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "8388608b", "spark.sql.execution.arrow.maxRecordsPerBatch": "4096"}


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, and keep their batches small.

    Clusters without a shared code folder install the package or pass it by ``--py-files``.
    """
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    return spark


#: Write a table to the shared folder and read it again.
materialise = written


_last: str | None = None
_caches: dict[str, list[Callable[[], None]]] = {}


def caches(group: str, *clear: Callable[[], None]) -> None:
    """Name what empties a group's caches of this worker process."""
    _caches[group] = list(clear)


def enter(group: str) -> None:
    """Empty the caches that other groups of operators left in this worker process, which serves one task after another, and
    give their memory back to the system."""
    global _last
    if _last in (None, group):
        _last = group
        return
    _last = group
    for name, clear in _caches.items():
        if name != group:
            for c in clear:
                c()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`"), F.lit(""))


def map_texts(df: DataFrame, text: Column, keep: dict[str, Column], worker: Callable, schema: str, group: str = "") -> DataFrame:
    """Run ``worker`` over Arrow batches of at most ``SLICE`` rows, without a shuffle.

    ``worker`` gets the texts as Python values; it returns the columns to add as pairs of name and array, in the order of
    ``schema``, which follow the kept ones.
    """
    ready(df.sparkSession)
    names = list(keep)
    thin = df.select(*[c.alias(f"k{i}") for i, c in enumerate(keep.values())], text.alias("__text"))
    heads = ", ".join(f"`{n}` {t.dataType.simpleString()}" for n, t in zip(names, thin.schema.fields[:-1], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(group)
        for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            made = worker(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(a for _, a in made)], names=[*names, *(n for n, _ in made)])

    return thin.mapInArrow(run, f"{heads}, {schema}")
