"""The choice of cards as a stream: lessons, pending cards and their deadlines as state variables of each session."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.lessons import CHOSEN, Lesson, _plain, _table, fields_of_lesson, packed

#: A lesson nobody takes up again for so long is forgotten; a card that isn't shown within the deadline gives way to a fallback.
REST_MS, DEADLINE_MS = 400 * 86_400_000, 20_000
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class Lessons(StatefulProcessor):
    """State: the lesson, the card that waits for being shown, when the session was last heard of, as one variable, since each look at one is a call to the JVM:
    it is read once and written once for a session's rows. Timers: the card's deadline, the session's rest; those that change are set after the rows."""

    def __init__(self, deadline_ms: int = DEADLINE_MS, rest_ms: int = REST_MS):
        self.deadline_ms, self.rest_ms = deadline_ms, rest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.session = handle.getValueState("session", f"{fields_of_lesson()}, waiting_turn long, waiting_card string, waiting_until long, heard_at long")

    def _held(self) -> tuple[Lesson, tuple | None, int | None]:
        """The lesson, the waiting card as (turn, card, until), the time of the last turn."""
        row = self.session.get()
        if row is None:
            return Lesson(), None, None
        *lesson, turn, card, until, heard = row
        return Lesson(*lesson), None if until is None else (turn, card, until), heard

    def _keep(self, lesson: Lesson, waiting: tuple | None, heard: int | None) -> None:
        self.session.update((*packed(lesson), *(waiting or (None, None, None)), heard))

    def _late(self, key: tuple, lesson: Lesson, waiting: tuple) -> tuple:
        """The waiting card was not shown in time: it gives way to a fallback, which counts as no card."""
        turn, card, _ = waiting
        lesson.present(card, False)
        return (int(key[0]), int(turn), card, None, lesson.phase, lesson.park_reason, lesson.help_level, lesson.stall, lesson.guesses, lesson.problem, lesson.level, "late")

    def _timer(self, before: int | None, after: int | None) -> None:
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before)
            if after is not None:
                self.handle.registerTimer(after)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        lesson, waiting, heard = self._held()
        deadline, out, at = waiting and waiting[2], [], 0
        for t in _plain(rows):
            at = t.ts // 1000
            if waiting and at >= waiting[2]:
                out.append(self._late(key, lesson, waiting))
            waiting = None  # late, or the next turn shows that the card was seen
            card, variant = lesson.choose(t)
            lesson.present(card, True)
            if not t.shown:
                waiting = (int(t.turn_id), card, at + self.deadline_ms)
            out.append(lesson.row(t, card, variant, "shown" if t.shown else "waiting"))
        self._timer(deadline, waiting and waiting[2])
        self._timer(None if heard is None else heard + self.rest_ms, at + self.rest_ms)
        self._keep(lesson, waiting, at)
        yield _table(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out, now = [], expiredTimerInfo.getExpiryTimeInMs()
        lesson, waiting, heard = self._held()
        if waiting and waiting[2] <= now:
            out.append(self._late(key, lesson, waiting))
            waiting = None
            self._keep(lesson, waiting, heard)
        if heard is not None and heard + self.rest_ms <= now:
            self.session.clear()
        yield _table(out)

    def close(self) -> None:
        pass


def chosen(turns: DataFrame, deadline_ms: int = DEADLINE_MS, late: str = "10 seconds", rest_ms: int = REST_MS) -> DataFrame:
    """The cards (CHOSEN) of a stream of turns, and a row `late` for each card that was not shown in time."""
    by = turns.withWatermark("ts", late).groupBy("session_id")
    return by.transformWithStateInPandas(Lessons(deadline_ms, rest_ms), CHOSEN, "Append", "EventTime")


@contextmanager
def rocks(spark: SparkSession):
    """State variables and timers need the store that keeps several column families."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)
