"""The specified engine's choice of a card for each turn, folded over a session in batch and as a stream.

What a turn says by itself (its type, the reconciled verdict) are columns. What it means depends on the turns before it, which a `Lesson` holds: the phase, the
help given so far, the problems tried. A lesson asks its rules in order; the first that has an answer gives the card. Both folds run the same rules over the same
rows in order, one session after another, so a batch of rows (in the stream, a session's rows of a batch) is all that a task holds at a time.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions import fixed
from . import dialogue

#: Limits of turns, stalls, guesses, checks and transfer problems; what turns get that need no judgment.
MAX_TURNS, MAX_STALL, GUESSES, CHECKS, TRANSFERS = 15, 6, 3, 2, 2
FINISHED = {"CONCEPT": "ANSWER_CONCEPT", "NEW_QUESTION": "CONFIRM_SWITCH"}
ASIDE = {"CONCEPT": "ANSWER_CONCEPT", "OFF_TOPIC": "REDIRECT", "INVALID": "ASK_WORK"}
_ASSISTS = {c[0] for c in fixed.CARDS if c[3]}
_LADDER_CARDS = {c for row in fixed.LADDERS.values() for c in row}

TURN = (
    "session_id long, turn_id long, ts timestamp, type string, safety boolean, fault boolean, valid boolean, tool string, verdict string, source string, has_work boolean, "
    "saw_last boolean, gap_improved boolean, error_at int, gap string, explanation string, said string, shown boolean, no_example boolean, no_prerequisite boolean, transfers int"
)
CHOSEN = "session_id long, turn_id long, card string, variant string, phase string, park_reason string, help_level int, stall int, guesses int, problem int, level string, status string"


@dataclass
class Lesson:
    """The state of one session; every field is a plain value, so it can be kept as a row."""

    phase: str = "ATTEMPTING"
    park_reason: str | None = None
    turns: int = 0
    help_level: int = 0
    stall: int = 0
    guesses: int = 0
    checks: int = 0
    problem: int = 0
    misses: int = 0
    solved: bool = False
    main_solved: bool = False
    attempted: bool = False
    assisted: bool = False
    error_at: int = -1
    gap: str | None = None
    diagnosis: str | None = None
    level: str | None = None
    last_card: str | None = None
    last_counts: bool = False

    def choose(self, t) -> tuple[str, str | None]:
        """(card, variant) of a turn."""
        self.assisted = self.assisted or bool(t.saw_last and self.last_card in _ASSISTS)
        for rule in (self._safety, self._finished, self._counted, self._partial, self._checking, self._aside):
            if (found := rule(t)) is not None:
                return found
        return self._limited(*self._attempt(t))

    def present(self, card: str, shown: bool) -> None:
        """The card counts as the last one if it was shown; a fallback in its place doesn't."""
        self.last_card = card if shown else None
        self.last_counts = shown and card in _LADDER_CARDS

    def _park(self, reason: str) -> None:
        self.phase, self.park_reason = "PARKED", reason

    def _limited(self, card: str, variant: str | None = None) -> tuple[str, str | None]:
        """What limits make of a card: too many turns end the question, a PARK without reason is the ladder's end."""
        if self.turns >= MAX_TURNS and card != "WRAP_UP":
            self._park("turn_limit")
            return ("WRAP_UP" if self.main_solved and not self.problem else "PARK"), variant
        if card == "PARK":
            self._park(self.park_reason or "ladder_end")
        return card, variant

    def _safety(self, t):
        if t.safety or self.park_reason == "safety":
            self._park("safety")
            return "SAFETY_STOP", None
        return None

    def _finished(self, t):
        if self.phase != "RESOLVED" and self.park_reason != "no_transfer_available":
            return None
        card = FINISHED.get(t.type, "REDIRECT")
        return card, "question_done" if card == "REDIRECT" else None

    def _counted(self, t):
        """Not a choice: a session that rested goes on where it stopped, and the turn counts."""
        if self.phase == "PARKED":
            self.turns = self.stall = 0
            self.help_level = max(0, self.help_level - 1)
            self.park_reason = self.last_card = None
            self.phase = "SOLVED_CHECK" if self.solved else "REMEDIATING"
        self.turns += not t.fault
        return None

    def _partial(self, t):
        if not t.valid:
            return self._limited("ASK_WORK", "partial_work")
        return self._limited("CONFIRM_SWITCH") if t.type == "NEW_QUESTION" else None

    def _aside(self, t):
        """Turns that the ladder has nothing to do with, in any phase."""
        if t.type in ASIDE:
            return self._limited(ASIDE[t.type], "off_topic" if t.type == "OFF_TOPIC" else None)
        if t.type == "ACK":
            return self._limited("RETRY_FULL" if self.attempted else "ELICIT_START")
        return None

    def _checking(self, t):
        """A solved problem is talked over: it may fall back, go on to the next problem, or be asked about once more."""
        if self.phase != "SOLVED_CHECK":
            return None
        if t.type in ASIDE:
            return self._aside(t)
        if t.explanation == "contradicts":
            self.phase, self.solved, self.help_level = "REMEDIATING", False, 0
            self.main_solved = self.main_solved and self.problem != 0
            self.diagnosis = t.said if t.said in fixed.LADDERS else "UNCLEAR"
            return self._limited(self._rung(t))
        if t.explanation == "sound" or self.checks + 1 >= CHECKS:
            return self._limited(self._onward(t))
        self.checks += 1
        return self._limited("ASK_WORK" if self.level == "D8" and not t.has_work else "CONFIRM_ASK_WHY")

    def _onward(self, t) -> str:
        if self.problem >= min(TRANSFERS, t.transfers):
            self._park("no_transfer_available")
            return "WRAP_UP"
        fresh = Lesson()
        for name in ("help_level", "stall", "guesses", "assisted", "attempted", "diagnosis", "gap", "error_at"):
            setattr(self, name, getattr(fresh, name))
        self.problem, self.solved, self.phase = self.problem + 1, False, "TRANSFER"
        return "TRANSFER"

    def _solve(self, t) -> str:
        """The active problem is right; a transfer problem solved alone, by the tool's word, ends the question."""
        self.solved = True
        self.main_solved = self.main_solved or self.problem == 0
        if self.phase == "TRANSFER" and t.source == "tool" and not self.assisted:
            self.phase = "RESOLVED"
            return "WRAP_UP"
        self.phase, self.checks = "SOLVED_CHECK", 0
        self.level = "D9" if self.assisted else "D10" if t.has_work else "D8"
        return "ASK_WORK" if self.level == "D8" else "CONFIRM_ASK_WHY"

    def _attempt(self, t) -> tuple[str, None]:
        tries = t.type in ("ANSWER", "PARTIAL")
        self.attempted = self.attempted or tries
        if tries and t.verdict == "CORRECT":
            return self._solve(t), None
        if tries and self.phase == "TRANSFER" and t.tool == "incorrect":
            self.misses += 1
            if self.misses >= TRANSFERS:
                self.park_reason = "transfer_budget"
                return "PARK", None
        if not t.fault:
            self._help(t)
            if self.stall >= MAX_STALL:
                self.park_reason = "stall"
                return "PARK", None
        self.diagnosis = t.verdict if tries else self.diagnosis or "D0"
        blind = t.type == "ANSWER" and t.tool == "incorrect" and not t.has_work
        self.guesses = self.guesses + 1 if blind else 0 if t.has_work else self.guesses
        if self.guesses >= GUESSES and self.last_card != "ASK_WORK":
            self.guesses, card = 0, "ASK_WORK"
        elif t.type == "VAGUE" and not self.help_level and self.last_card != "CLARIFY":
            card = "CLARIFY"
        else:
            card = self._rung(t)
        if self.phase in ("ATTEMPTING", "TRANSFER"):
            self.phase = "REMEDIATING"
        return card, None

    def _help(self, t) -> None:
        """More help for turns without progress, none left over when something moved."""
        at = -1 if t.error_at is None else int(t.error_at)
        later, other = at > self.error_at >= 0, bool(t.gap and self.gap and t.gap != self.gap)
        self.error_at = max(self.error_at, at)
        if t.gap_improved or later:
            self.help_level = self.stall = 0
        else:
            self.stall += bool(t.saw_last)
            self.help_level = 0 if other else self.help_level + bool(t.saw_last and self.last_counts)
        if t.type == "DEMAND":
            self.help_level = max(1, self.help_level)
        self.gap = t.gap or self.gap

    def _rung(self, t) -> str:
        """The ladder's card at the help level; cards that lack their input, or were just shown, are passed over and raise the level."""
        row = fixed.LADDERS[self.diagnosis]
        lacking = {c for c, absent in (("DEMO_SIMILAR", t.no_example), ("PREREQ_CHECK", t.no_prerequisite), ("PREREQ_REVIEW", t.no_prerequisite)) if absent}
        first = min(self.help_level, len(row) - 1)
        for level in range(first, len(row)):
            if row[level] == "PARK" or (row[level] not in lacking and (t.fault or row[level] != self.last_card)):
                self.help_level = self.help_level if level == first else level
                return row[level]
        raise ValueError(f"ladder {self.diagnosis} has no end")

    def row(self, t, card: str, variant: str | None, status: str) -> tuple:
        return (int(t.session_id), int(t.turn_id), card, variant, self.phase, self.park_reason, self.help_level, self.stall, self.guesses, self.problem, self.level, status)


_COLUMNS = [c.split()[0] for c in CHOSEN.split(", ")]
_NO_TIME = np.datetime64("NaT").astype("int64")
#: A turn as plain values.
Turn = namedtuple("Turn", [c.split()[0] for c in TURN.split(", ")])


def _table(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS)


def _plain(dfs: Iterable[pd.DataFrame]) -> list[Turn]:
    """Turns of some tables in order, missing values as None, the time in microseconds."""
    held = []
    for df in dfs:
        columns = []
        for name in Turn._fields:
            x = df[name].to_numpy()
            if x.dtype.kind == "M":
                x = x.astype("datetime64[us]").astype("int64")
                columns.append([None if v == _NO_TIME else v for v in x.tolist()])
            else:
                columns.append([None if v is None or v is pd.NA or v != v else v for v in x.tolist()] if x.dtype.kind in "fO" else x.tolist())
        held += map(Turn._make, zip(*columns, strict=True))
    last = float("inf")
    return sorted(held, key=lambda t: (last if t.ts is None else t.ts, last if t.turn_id is None else t.turn_id))


def prepared(turns: DataFrame) -> DataFrame:
    """Turns (TURN, with intents, missing_constant, model, confidence in place of type, verdict, source) with what each says by itself."""
    verdict = dialogue.reconciled(F.col("tool"), F.col("missing_constant"), F.col("model"), F.col("confidence"))
    own = turns.withColumn("type", dialogue.primary_type(F.col("intents"))).withColumn("_v", verdict)
    own = own.withColumns({"verdict": F.col("_v.verdict"), "source": F.col("_v.source"), "said": F.col("model")})
    return own.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in TURN.split(", ")])


def chosen(turns: DataFrame) -> DataFrame:
    """The cards (CHOSEN) of all turns (TURN), each session folded in the order of time.

    Sessions lie whole in a partition, one after another, so a task folds batches of rows of many sessions and keeps one lesson.
    """
    kinds = StructType.fromDDL(CHOSEN)
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in kinds])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lesson = object(), Lesson()
        for batch in batches:
            out = []
            for t in map(Turn._make, zip(*[batch.column(n).to_pylist() for n in Turn._fields], strict=True)):
                if t.session_id != at:
                    at, lesson = t.session_id, Lesson()
                card, variant = lesson.choose(t)
                lesson.present(card, t.shown)
                out.append(lesson.row(t, card, variant, "shown" if t.shown else "fallback"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    rows = turns.withColumn("ts", F.unix_micros("ts")).repartition("session_id").sortWithinPartitions("session_id", F.asc_nulls_last("ts"), F.asc_nulls_last("turn_id"))
    return rows.mapInArrow(fold, kinds)


def fields_of_lesson() -> str:
    """The lesson as the schema of a state variable."""
    kinds = {"int": "int", "bool": "boolean", "str": "string", "str | None": "string"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in fields(Lesson))


def packed(lesson: Lesson) -> tuple:
    return tuple(vars(lesson).values())
