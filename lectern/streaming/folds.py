"""Structured Streaming twins of the batch operators: sessions, state folds, commits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: What folds read of an event.
_FOLDED = ("user_id", "event_id", "event_type", "ts")
_LAST = np.iinfo(np.int64).max


def _ordered(pdfs: Iterator[pd.DataFrame]) -> Iterator[tuple[int, int, str]]:
    """(event_id, event_type, microseconds) of a user's events of a batch in the order of time, then id.

    A batch has few events of each user, so what a table costs counts more than its rows: the columns become arrays and nothing else of the table is touched.
    """
    held = list(pdfs)
    ts, ids, kinds = (np.concatenate([p[c].to_numpy() for p in held]) for c in ("ts", "event_id", "event_type"))
    none, ts = np.isnat(ts), ts.astype("datetime64[us]").astype(np.int64)
    order = np.lexsort((ids, np.where(none, _LAST, ts)))
    return zip(ids[order].tolist(), kinds[order].tolist(), ts[order].tolist(), strict=True)


def windowed_counts(events: DataFrame, length: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Events and value by window and type; rows later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each user, ended by a gap."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def running_state(events: DataFrame) -> DataFrame:
    """Per user: events seen, errors in a row, and the help level they raise; rows of a batch are taken in the order of time."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, stall, level = state.get if state.exists else (0, 0, 0)
        out = []
        for event_id, kind, _ in _ordered(pdfs):
            seen += 1
            stall = stall + 1 if kind == "error" else 0
            level = min(3, level + 1) if stall >= 2 else level
            out.append((key[0], event_id, seen, stall, level))
        state.update((seen, stall, level))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "seen", "stall", "help_level"])

    return events.select(*_FOLDED).groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, seen long, stall long, help_level long", "seen long, stall long, help_level long", "append", GroupStateTimeout.NoTimeout)


def commits(actions: DataFrame, deliveries: DataFrame, late: str = "1 hour") -> DataFrame:
    """Stream-stream join: actions (action_id, ts) that a delivery within the hour presented.

    State is kept by id and hour: a delivery looks for actions of its own hour and of the one before, not among all of its id.
    """
    hour = lambda ts: F.floor(F.unix_micros(ts) / 3_600_000_000)
    a = actions.withWatermark("ts", late).withColumn("_hour", hour("ts"))
    d = deliveries.withWatermark("delivered_ts", late).withColumn("_near", F.explode(F.array(hour("delivered_ts"), hour("delivered_ts") - 1)))
    met = a.join(d, F.expr("action_id = delivered_id AND _hour = _near AND delivered_ts BETWEEN ts AND ts + INTERVAL 1 HOUR"))
    return met.drop("_hour", "_near")


def first_of_key(events: DataFrame, key: str, late: str = "2 hours") -> DataFrame:
    """Events whose key was not seen before within the watermark: an id is used once (submissions, deliveries, results)."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def snapshots(events: DataFrame) -> DataFrame:
    """The state of every session so far: events, the last one and its type, errors. Complete mode: one row for each session."""
    return events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max("event_id").alias("last_event"), F.count_if(F.col("event_type") == "error").alias("errors"))


def confirmed_once(events: DataFrame) -> DataFrame:
    """Reviews open with a view and are confirmed by a purchase, once: state is deleted by its use, so a second confirmation finds none. Rows of a batch are taken in the order of time."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened = state.get[0] if state.exists else None
        out = []
        for event_id, kind, _ in _ordered(pdfs):
            if kind == "view":
                opened = event_id
            elif kind == "purchase":
                out.append((key[0], event_id, opened, "rejected" if opened is None else "confirmed"))
                opened = None
        if opened is not None:
            state.update((opened,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["user_id", "event_id", "review_id", "status"]).astype({"review_id": "Int64"})

    return events.select(*_FOLDED).groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, review_id long, status string", "review_id long", "append", GroupStateTimeout.NoTimeout)


def expiring(events: DataFrame, ttl_seconds: int = 86_400, late: str = "1 hour") -> DataFrame:
    """Pending actions with a time to live: a view opens one, a click of the same user applies it; when its time has passed, by the next event or by the
    watermark, it is discarded as expired and its state deleted, so state doesn't outlive the time to live."""

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        opened, since = state.get if state.exists else (None, None)
        if state.hasTimedOut:
            out.append((key[0], opened, "expired"))
            state.remove()
        else:
            for event_id, kind, micros in _ordered(pdfs):
                at = micros // 1000
                if opened is not None and at >= since + ttl_seconds * 1000:
                    out.append((key[0], opened, "expired"))
                    opened = None
                if kind == "view":
                    if opened is not None:
                        out.append((key[0], opened, "superseded"))
                    opened, since = event_id, at
                elif kind == "click" and opened is not None:
                    out.append((key[0], opened, "applied"))
                    opened = None
            if opened is None:
                if state.exists:
                    state.remove()
            else:
                state.update((opened, since))
                state.setTimeoutTimestamp(max(since + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "status"])

    return events.select(*_FOLDED).withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, status string", "opened long, since long", "append", GroupStateTimeout.EventTimeTimeout)
