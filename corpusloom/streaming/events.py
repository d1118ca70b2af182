"""Streams of events: quiet-gap sessions, request and finish pairs, first-seen rows, entries that expire."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quiet_gap_sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, events): runs of events no further apart than the gap; works on batches and streams alike."""
    x = events.withWatermark(ts, late) if events.isStreaming else events
    s = x.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events"))
    return s.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "events")


def pair_events(requests: DataFrame, finishes: DataFrame, key: str = "request_id", ts: str = "ts", within: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests with their finish at most `within` later; state beyond that is dropped."""
    a, b = requests.withColumnRenamed(ts, "request_ts"), finishes.withColumnRenamed(ts, "finish_ts").withColumnRenamed(key, "_k")
    if requests.isStreaming:
        a, b = a.withWatermark("request_ts", late), b.withWatermark("finish_ts", late)
    return a.join(b, F.expr(f"{key} = _k AND finish_ts >= request_ts AND finish_ts <= request_ts + interval {within}")).drop("_k")


def first_events(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def windowed_counts(events: DataFrame, ts: str = "ts", window: str = "5 minutes", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    x = events.withWatermark(ts, late) if events.isStreaming else events
    return x.groupBy(F.window(ts, window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def latest_with_ttl(writes: DataFrame, key: str, ts: str, ttl_seconds: int, late: str = "1 hour"):  # noqa: ANN201
    """Streaming cache: (key, ts, value) of each write that is new or newer than what is kept; kept entries expire ttl after their time."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k, batches, state: GroupState):  # noqa: ANN001, ANN202
        if state.hasTimedOut:
            state.remove()
            return
        best = state.get if state.exists else None
        for pdf in batches:
            for t, v in zip(pdf[ts].astype("int64") // 10**3, pdf["value"]):
                if best is None or t > best[0]:
                    best = (int(t), str(v))
        if best is not None:
            state.update(best)
            state.setTimeoutTimestamp(max(best[0] // 1000 + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
            yield pd.DataFrame({key: [k[0]], "at_us": [best[0]], "value": [best[1]]})

    kind = writes.schema[key].dataType.simpleString()
    return writes.withWatermark(ts, late).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, at_us long, value string", "at_us long, value string", "update", GroupStateTimeout.EventTimeTimeout)
