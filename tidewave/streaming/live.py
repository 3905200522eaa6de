"""The batch operators' streaming kin: windows, sessions, dedup by the event before, interval joins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, unit, n of tumbling or sliding windows. events(ts, unit)."""
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(span, "unit").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "unit", "n")


def bouts(events: DataFrame, pause: str, late: str = "1 hour") -> DataFrame:
    """unit, start, stop, n of sessions that a pause ends."""
    w = F.session_window("ts", pause)
    return events.withWatermark("ts", late).groupBy(w, "unit").agg(F.count("*").alias("n"), F.max("ts").alias("stop")).select("unit", F.col("session_window.start").alias("start"), "stop", "n")


def distinct_events(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def refractory(events: DataFrame, ticks: int, late: str = "1 hour") -> DataFrame:
    """Drops an event at most so many ticks after the unit's one before; the last time of each unit is state.

    Within a batch a unit's events are taken in order of time. The state of a
    unit ends when the watermark passes its last event.
    """

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["t", "id"], kind="stable")
        gap = rows.t.diff()
        if last is not None and len(rows):
            gap.iloc[0] = rows.t.iloc[0] - last
        state.update((int(rows.t.iloc[-1]),))
        state.setTimeoutTimestamp(max(int(rows.t.iloc[-1] // 1000) + ticks // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield rows[gap.isna() | (gap > ticks)][["unit", "id", "t"]]

    timed = events.withWatermark("ts", late).select("unit", "id", "t", "ts")
    return timed.groupBy("unit").applyInPandasWithState(keep, "unit long, id long, t long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def aligned(events: DataFrame, spikes: DataFrame, before: str, after: str, late: str = "1 hour") -> DataFrame:
    """unit, event_id, id: spikes around events, an interval join of two streams. events(unit, event_id, event_ts), spikes(unit, id, ts)."""
    e = events.withWatermark("event_ts", late).alias("e")
    s = spikes.withWatermark("ts", late).alias("s")
    near = F.expr(f"e.unit = s.unit AND s.ts >= e.event_ts - INTERVAL {before} AND s.ts <= e.event_ts + INTERVAL {after}")
    return e.join(s, near).select("e.unit", "event_id", "id")
