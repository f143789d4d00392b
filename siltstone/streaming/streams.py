"""Structured Streaming twins: extraction of arriving pages, windowed audit counts, rolling quotas, health.

Stateful operators are keyed and keep the same state class as the batch folds (``keyed.py``), so a stream that is read to its end gives the
batch result. A key's state is its open window or its last outcomes; a tenant's state goes once the watermark has passed its
window, a model's when it has had no outcome for a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keyed import HealthFold, QuotaFold, keyed_fold


def page_stream(pages: DataFrame) -> DataFrame:
    """Records of arriving pages (page_id, url, html): the batch plan, without state."""
    from siltstone.operators.extract import extract, fetches_from_pages, records

    return records(extract(fetches_from_pages(pages)))


def audit_windows(events: DataFrame, ts: str, kind: str, value: str, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(window_start, kind, n, total) per window of event time; rows later than ``lateness`` are dropped."""
    late = events.withWatermark(ts, lateness) if events.isStreaming else events
    return late.groupBy(F.window(ts, width), kind).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(
        F.col("window.start").alias("window_start"), kind, "n", "total"
    )


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """(session_start, session_end, key, n): runs of events of a key with no gap as long as ``gap``."""
    late = events.withWatermark(ts, lateness) if events.isStreaming else events
    return late.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n"
    )


def quota_stream(requests: DataFrame, limit: int = 300, window_ms: int = 60_000, lateness: str = "10 minutes") -> DataFrame:
    """Admissions of a stream of requests (tenant, request_id, at_ms, seeds), decided as they arrive; the state is the open window.

    The requests of one trigger are taken in order of time. The state of an idle tenant is removed once the watermark has passed its last admission's window,
    which changes no result; rows later than ``lateness`` are dropped.
    """
    kind = requests.schema["tenant"].dataType.simpleString()
    narrow = requests.select("tenant", "request_id", "at_ms", "seeds", F.timestamp_millis("at_ms").alias("ts")).withWatermark("ts", lateness)
    return keyed_fold(narrow, "tenant", QuotaFold(limit, window_ms), f"tenant {kind}, request_id long, ok boolean, used long")


def health_stream(outcomes: DataFrame, forget_ms: int = 7 * 24 * 3600 * 1000, lateness: str = "10 minutes") -> DataFrame:
    """Demotion after every outcome of a stream (model, seq, outcome and, for states that expire, at_ms).

    With times, a model begins anew once the watermark is ``forget_ms`` past its last outcome; without, its state stays.
    """
    kind = outcomes.schema["model"].dataType.simpleString()
    timed = "at_ms" in outcomes.columns
    rows = outcomes.select("model", "seq", "outcome", *(["at_ms"] if timed else []))
    if timed:
        rows = rows.withColumn("ts", F.timestamp_millis("at_ms")).withWatermark("ts", lateness)
    return keyed_fold(rows, "model", HealthFold(forget_ms if timed else None), f"model {kind}, seq long, demotion int")


def append_audit(stream: DataFrame, path: str, checkpoint: str):
    """Start writing an audit stream to a table of files, exactly once per row."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()
