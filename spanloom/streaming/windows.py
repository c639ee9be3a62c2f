"""Structured Streaming: windowed latency summaries, and traces assembled until they fall quiet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summaries(spans: DataFrame, length: str = "10 minutes", slide: str | None = None, late: str | None = None) -> DataFrame:
    """window_start, op, spans, total, longest, errors by event_time: tumbling, or sliding if `slide` is given. The same plan serves
    batches and streams; `late` sets the watermark of a stream."""
    rows = spans.withWatermark("event_time", late) if late else spans
    window = F.window("event_time", length, slide) if slide else F.window("event_time", length)
    out = rows.groupBy(window, "op").agg(F.count("*").alias("spans"), F.sum("dur").alias("total"), F.max("dur").alias("longest"), F.count(F.when(F.col("is_error"), 1)).alias("errors"))
    return out.select(F.col("window.start").alias("window_start"), "op", "spans", "total", "longest", "errors")


def assembled(spans: DataFrame, quiet: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """One row a trace with its spans, given out when no span has come for `quiet` and the watermark has passed. A trace whose spans pause
    longer comes in several rows."""
    fields = [c for c in spans.columns if c not in ("trace_id", "event_time")]
    rows = spans.withWatermark("event_time", late).groupBy("trace_id", F.session_window("event_time", quiet).alias("session")).agg(F.collect_list(F.struct(*fields)).alias("spans"))
    return rows.select("trace_id", F.col("session.start").alias("first_seen"), "spans")


def analysed(stream: DataFrame, analyse: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Start a query that runs a batch analysis on the spans of each batch of assembled traces and writes the result for that batch,
    so that a batch that is run again replaces its own output."""

    def one(batch: DataFrame, number: int) -> None:
        analyse(batch.select("trace_id", F.explode("spans").alias("s")).select("trace_id", "s.*")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).outputMode("append")
