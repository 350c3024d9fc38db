"""Streaming forms of the stateful operators: funnels in event-time windows, keyed moving averages, edge states."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "1 hour"


def timed(events: DataFrame, ts: str = "ts") -> DataFrame:
    """events with event_time from epoch seconds, watermarked."""
    return events.withColumn("event_time", F.timestamp_seconds(F.col(ts))).withWatermark("event_time", LATE)


def _counts():
    n = lambda k: F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).cast("bigint").alias(k + "s")
    return n("accept"), n("cancel"), n("complete")


def tumbling_funnel(events: DataFrame, length: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts by driver and window, tumbling or sliding."""
    w = F.window("event_time", length, slide) if slide else F.window("event_time", length)
    return timed(events).groupBy("driver_id", w.alias("w")).agg(*_counts()).select("driver_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "accepts", "cancels", "completes")


def session_funnel(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Counts by driver and session: events with no longer gap between them."""
    return timed(events).groupBy("driver_id", F.session_window("event_time", gap).alias("w")).agg(*_counts()).select("driver_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "accepts", "cancels", "completes")


def once_per_key(events: DataFrame, *keys: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return timed(events).dropDuplicatesWithinWatermark([*keys])


def moving_average(events: DataFrame, key: str, x: str, alpha: float, start: float | None = None) -> DataFrame:
    """(key, value, n) after each batch: a keyed moving average, rows of a batch in (ts, id) order. Equals the batch fold where rows arrive in order."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, n = state.get if state.exists else (start, 0)
        rows = pd.concat(list(batches)).sort_values(["ts", "id"], kind="stable")
        for v in rows["x"].dropna():
            value = v if value is None or pd.isna(value) else alpha * v + (1 - alpha) * value
            n += 1
        state.update((value, n))
        yield pd.DataFrame({"key": [str(k[0])], "value": [value], "n": [n]})

    rows = events.select(F.col(key).cast("string").alias("key"), "ts", "id", F.col(x).cast("double").alias("x"))
    return rows.groupBy("key").applyInPandasWithState(step, "key string, value double, n bigint", "value double, n bigint", "update", GroupStateTimeout.NoTimeout)


def start(df: DataFrame, sink, checkpoint: str, mode: str = "update"):
    """Runs a streaming frame into a sink until what is there has been read."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
