"""Structured Streaming twins: transitions, popularity and sessions as events arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "user_id long, source_id long, target_id long, source_ts long, target_ts long, gap long"
_STATE = "item_id long, ts long, tied boolean, event_id long"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Strict tie rule: no transition out of a group of tied events. State: the last event and whether it is tied."""
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
    last = state.get if state.exists else None
    made = []
    for item, ts, event in zip(rows["item_id"], rows["ts"], rows["event_id"], strict=True):
        item, ts, event = int(item), int(ts), int(event)
        if last is not None and ts < last[1]:
            continue  # late: its time has been passed
        if last is not None and ts == last[1]:
            last = (item, ts, True, event)
            continue
        if last is not None and not last[2]:
            made.append((int(key[0]), last[0], item, last[1], ts, ts - last[1]))
        last = (item, ts, False, event)
    state.update(last)
    yield pd.DataFrame(made, columns=[c.split()[0] for c in _OUT.split(", ")])


def stream_transitions(events: DataFrame) -> DataFrame:
    """events(user_id, item_id, ts, event_id) as a stream -> transitions.

    A pair is emitted when its target arrives; that the target's own time is tied matters for the pair
    after it alone, so no look-ahead is held. For input in the order of each user's times: a row older than the
    user's last one is left out. ordered_transitions() takes rows in any order within a lateness.
    """
    return events.groupBy("user_id").applyInPandasWithState(_step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


_SHIFT = 1 << 32  # seconds: Spark's first watermark is 1970, under which it would drop rows at times of 0 or less
_BUFFER = "item_id long, ts long, tied boolean, held_ts array<long>, held_events array<long>, held_items array<long>"


def _ordered_step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The strict tie rule on rows that the watermark has passed; the others wait in the state, with a timer for the earliest.

    Rows at or under the watermark of the batch before never get here, so what is passed is complete.
    """
    mark = state.getCurrentWatermarkMs()
    item, ts, tied, *held = state.get if state.exists else (None, None, None, [], [], [])
    waiting = list(zip(*held, strict=True))
    for rows in batches:
        waiting.extend(zip(rows["ts"].tolist(), rows["event_id"].tolist(), rows["item_id"].tolist(), strict=True))
    waiting.sort()
    passed = sum(1 for row in waiting if (row[0] + _SHIFT) * 1000 < mark)
    made = []
    for at, _, now in waiting[:passed]:
        if at == ts:
            item, tied = now, True
            continue
        if ts is not None and not tied:
            made.append((int(key[0]), item, now, ts, at, at - ts))
        item, ts, tied = now, at, False
    waiting = waiting[passed:]
    state.update((item, ts, tied, *([row[i] for row in waiting] for i in range(3))))
    if waiting:
        state.setTimeoutTimestamp(max((waiting[0][0] + _SHIFT) * 1000, mark + 1))
    yield pd.DataFrame(made, columns=[c.split()[0] for c in _OUT.split(", ")])


def ordered_transitions(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """events(user_id, item_id, ts in seconds, event_id) as a stream, rows in any order -> transitions.

    A row waits until the watermark, the latest time less `late`, has passed it, and is then taken in the order of
    (ts, event_id). So arrivals within `late` give the batch result however they are cut into micro-batches; rows
    under the watermark are dropped by Spark, which counts them, and rows over it stay in the state. The state of a
    user is the last passed event and the rows within `late`. Rows with a null among the four columns are left out.
    Times are from the year 1834 to 2126.
    """
    whole = events.dropna(subset=["user_id", "item_id", "ts", "event_id"])
    timed = whole.select("user_id", "item_id", "ts", "event_id", F.timestamp_seconds(F.col("ts") + _SHIFT).alias("event_time")).withWatermark("event_time", late)
    return timed.groupBy("user_id").applyInPandasWithState(_ordered_step, _OUT, _BUFFER, "append", GroupStateTimeout.EventTimeTimeout)


def stream_popularity(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """events(event_time, item_id): counts in tumbling windows; later rows than the watermark are dropped."""
    return events.withWatermark("event_time", late).groupBy(F.window("event_time", length), "item_id").agg(F.count("*").alias("count")).select(F.col("window.start").alias("window_start"), "item_id", "count")


def stream_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """events(event_time, user_id): sessions that end after a gap without events; an event at the end itself begins another.

    Spark joins windows that touch, so they are a microsecond, the unit of its times, shorter while it merges them.
    """
    window = F.session_window("event_time", f"{gap} -1 microseconds")
    found = events.withWatermark("event_time", late).groupBy(window, "user_id").agg(F.count("*").alias("events"))
    return found.select("user_id", F.col("session_window.start").alias("session_start"), (F.col("session_window.end") + F.expr("interval 1 microsecond")).alias("session_end"), "events")
