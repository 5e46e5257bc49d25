"""Streaming forms of batch operators: an addition, nothing of the kind was asked of the batch engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_messages(stream: DataFrame, key: str = "message_id", ts: str = "ts", lateness: str = "7 days") -> DataFrame:
    """One row per message id among rows at most `lateness` apart."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def subject_sessions(stream: DataFrame, keys: list[str], ts: str = "ts", gap: str = "30 days", lateness: str = "1 day") -> DataFrame:
    """Sessions of messages with the same keys that follow each other within the gap."""
    own = stream.withWatermark(ts, lateness).groupBy(*keys, F.session_window(ts, gap).alias("session"))
    return own.agg(F.count(F.lit(1)).alias("messages")).select(*keys, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "messages")
