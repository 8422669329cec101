"""A live ledger: every closed window of a stream goes through the batch detector, once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ledgerloom.config import Detector
from ledgerloom.functions.scalars import micros
from ledgerloom.storage import written


def closed_windows(stream: DataFrame, cfg: Detector, late: str = "1 hour") -> DataFrame:
    """(window, n, txns) of every window once the watermark has passed its end. ``stream`` has a timestamp ``ts``; windows are
    aligned to the epoch, as a stream has no first transfer to wait for."""
    kept = stream if cfg.formats is None else stream.where(F.col("payment_format").isin(*cfg.formats))
    row = F.struct("txn_id", "ts", "src", "dst", "amount", "payment_format", "is_laundering", "pattern_id")
    return kept.withWatermark("ts", late).groupBy(F.window("ts", f"{cfg.window_hours} hours", f"{cfg.stride_hours} hours")).agg(F.count("*").alias("n"), F.collect_list(row).alias("txns"))


def detect_stream(stream: DataFrame, cfg: Detector, sink: Callable[[DataFrame, DataFrame, int], None], checkpoint: str, late: str = "1 hour", trigger: dict | None = None) -> StreamingQuery:
    """Run ``sink(candidates, members, batch)`` on the groups of every closed window. A repeated batch has the same number."""
    from ledgerloom.operators import detect

    def batch(df: DataFrame, no: int) -> None:
        start = F.unix_micros("window.start")
        rows = df.select(start.alias("window_start"), F.floor(start / F.lit(cfg.stride)).alias("w"), F.explode("txns").alias("t")).select("w", "window_start", "t.*")
        rows = written(rows.withColumn("ts_us", micros(F.col("ts").cast("timestamp_ntz"))), "closed")
        if rows.limit(1).count():
            sink(*detect.candidates(rows.drop("w", "window_start").dropDuplicates(["txn_id"]), cfg, rows), no)

    out = closed_windows(stream, cfg, late).writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return out.trigger(**(trigger or {"availableNow": True})).start()
