"""Usage as a stream (an extension): monthly counters kept by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def monthly_counts(events: DataFrame, keys: list[str], at: str = "ts", delay: str = "1 day") -> DataFrame:
    """Counts and latest time by keys and month of a stream; ``at`` may be without a zone (read as UTC)."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return timed.groupBy(*keys, F.date_format(at, "yyyy-MM").alias("year_month")).agg(F.count(F.lit(1)).alias("n"), F.max(at).alias("last_updated"))


def session_counts(events: DataFrame, keys: list[str], at: str = "ts", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of a stream by keys: rows less than a gap apart."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)
    return timed.groupBy(*keys, F.session_window(at, gap).alias("session")).agg(F.count(F.lit(1)).alias("n"))


def accumulate(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """U1 over a stream: each micro-batch goes to ``merge``, which adds it to stored counters; replays are told by the batch number."""
    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(merge).trigger(availableNow=True).start()
