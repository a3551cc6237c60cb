"""Offers that expire, and repeated offers within a moment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def live_offers(offers: DataFrame, now: str, ttl_seconds: int = 120, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """The latest offer of each key that has not expired at ``now``; one whose
    latest row is a dismissal is gone."""
    last = offers.groupBy(key).agg(F.max_by(F.struct(ts, "action"), F.struct(ts, "event_id")).alias("x"))
    at = F.lit(now).cast("timestamp")
    return last.where(
        (F.col("x.action") == "offer") & (F.col(f"x.{ts}").cast("timestamp") > at - F.expr(f"INTERVAL {ttl_seconds} SECONDS"))
    ).select(key, F.col(f"x.{ts}").alias(ts))


def debounced(events: DataFrame, gap_seconds: float = 1.5, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """The last event of every burst: one that no other follows within the gap."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    following = F.lead(F.col(ts).cast("timestamp").cast("double")).over(w)
    wait = following - F.col(ts).cast("timestamp").cast("double")
    return events.withColumn("__w", wait).where(F.col("__w").isNull() | (F.col("__w") > gap_seconds)).drop("__w")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """Session windows per key, for streams and tables alike."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.session_window(ts, gap).alias("s"), key)
        .agg(F.count("*").alias("n"))
        .select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
    )
