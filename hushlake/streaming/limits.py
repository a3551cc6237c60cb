"""Stateful limits: token buckets, offers that expire, unchanged screens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RATE, BURST = 5.0, 20.0


def bucket_fold(times: Column, rate: float = RATE, burst: float = BURST) -> Column:
    """Which of a client's requests (seconds, ascending) a bucket lets through."""
    start = F.struct(F.lit(burst).alias("tokens"), F.lit(None).cast("double").alias("last"), F.array().cast("array<boolean>").alias("ok"))

    def step(acc: Column, t: Column) -> Column:
        filled = F.least(F.lit(burst), acc.tokens + F.coalesce(t - acc["last"], F.lit(0.0)) * rate)
        ok = filled >= 1
        return F.struct(
            F.when(ok, filled - 1).otherwise(filled).alias("tokens"), t.alias("last"), F.concat(acc.ok, F.array(ok)).alias("ok")
        )

    return F.aggregate(times, start, step, lambda acc: acc.ok)


def bucket_stream(events: DataFrame, key: str = "user_id", ts: str = "ts", rate: float = RATE, burst: float = BURST) -> DataFrame:
    """(key, seen, denied) per micro-batch; state is two numbers per client."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last, seen, denied = state.get if state.exists else (burst, None, 0, 0)
        times = sorted(t for f in frames for t in f["t"])
        for t in times:
            tokens = min(burst, tokens + ((t - last) * rate if last is not None else 0))
            last, seen = t, seen + 1
            if tokens >= 1:
                tokens -= 1
            else:
                denied += 1
        state.update((tokens, last, seen, denied))
        yield pd.DataFrame({key: [k[0]], "seen": [seen], "denied": [denied]})

    timed = events.select(F.col(key), F.col(ts).cast("timestamp").cast("double").alias("t"))
    return timed.groupBy(key).applyInPandasWithState(
        update,
        f"{key} long, seen long, denied long",
        "tokens double, last double, seen long, denied long",
        "update",
        GroupStateTimeout.NoTimeout,
    )


def windowed_counts(events: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type; late rows count up to the watermark."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, width).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )
