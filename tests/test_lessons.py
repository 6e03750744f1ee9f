"""The choice of cards: hand-made sessions with their expected cards, limits on random sessions, stream and batch, a deadline that fires."""

import dataclasses
import random
from types import SimpleNamespace

import pytest

from lectern.functions import fixed
from lectern.operators import lessons
from lectern.operators.lessons import Lesson
from lectern.streaming import lessons as stream
from lectern.streaming.runs import available

PLAIN = dict(
    session_id=1, turn_id=0, type="ANSWER", safety=False, fault=False, valid=True, tool="unknown", verdict="D5", source="model", has_work=True, saw_last=True,
    gap_improved=False, error_at=None, gap=None, explanation="none", said=None, shown=True, no_example=False, no_prerequisite=False, transfers=2,
)


def play(*turns, lesson=None):
    """The cards of turns given as changes of a plain one; the lesson after them."""
    lesson, cards = lesson or Lesson(), []
    for t in turns:
        card, variant = lesson.choose(SimpleNamespace(**{**PLAIN, **t}))
        lesson.present(card, t.get("shown", True))
        cards.append(card if variant is None else f"{card}:{variant}")
    return cards, lesson


RIGHT = dict(verdict="CORRECT", tool="correct", source="tool")

SESSIONS = {
    "a ladder to its end": ([{}] * 5, ["HINT_POINT", "HINT_TEACH", "DEMO_SIMILAR", "PREREQ_REVIEW", "PARK"], dict(phase="PARKED", park_reason="ladder_end")),
    "cards without input": ([dict(no_example=True, no_prerequisite=True)] * 3, ["HINT_POINT", "HINT_TEACH", "PARK"], dict(phase="PARKED")),
    "progress starts it anew": ([{}, {}, dict(gap_improved=True)], ["HINT_POINT", "HINT_TEACH", "HINT_POINT"], dict(stall=0, help_level=0)),
    "an error further on": ([dict(error_at=1), dict(error_at=2)], ["HINT_POINT", "HINT_TEACH"], dict(help_level=1, stall=0, error_at=2)),
    "solved alone twice": ([RIGHT, dict(explanation="sound"), RIGHT], ["CONFIRM_ASK_WHY", "TRANSFER", "WRAP_UP"], dict(phase="RESOLVED", problem=1, main_solved=True)),
    "solved with help": ([{}, {**RIGHT}], ["HINT_POINT", "CONFIRM_ASK_WHY"], dict(level="D9", phase="SOLVED_CHECK")),
    "right without work": ([dict(**RIGHT, has_work=False), dict(has_work=False), dict(has_work=False)], ["ASK_WORK", "ASK_WORK", "TRANSFER"], dict(phase="TRANSFER")),
    "it was luck": ([RIGHT, dict(explanation="contradicts", said="D3")], ["CONFIRM_ASK_WHY", "ASK_REASON"], dict(phase="REMEDIATING", main_solved=False, solved=False)),
    "no problem left": ([RIGHT, dict(explanation="sound", transfers=0), dict(type="CONCEPT"), dict(type="ACK")], ["CONFIRM_ASK_WHY", "WRAP_UP", "ANSWER_CONCEPT", "REDIRECT:question_done"], dict(park_reason="no_transfer_available")),
    "two misses in transfer": (
        [RIGHT, dict(explanation="sound"), dict(tool="incorrect"), RIGHT, dict(explanation="sound"), dict(tool="incorrect")],
        ["CONFIRM_ASK_WHY", "TRANSFER", "HINT_POINT", "CONFIRM_ASK_WHY", "TRANSFER", "PARK"], dict(park_reason="transfer_budget"),
    ),
    "guessing": ([dict(tool="incorrect", has_work=False, saw_last=False)] * 3, ["HINT_POINT", "HINT_TEACH", "ASK_WORK"], dict(guesses=0)),
    "safety": ([dict(safety=True), {}], ["SAFETY_STOP", "SAFETY_STOP"], dict(phase="PARKED", park_reason="safety")),
    "asides": (
        [dict(type="ACK"), dict(type="CONCEPT"), dict(type="OFF_TOPIC"), dict(type="INVALID"), dict(type="NEW_QUESTION"), dict(valid=False), {}, dict(type="ACK")],
        ["ELICIT_START", "ANSWER_CONCEPT", "REDIRECT:off_topic", "ASK_WORK", "CONFIRM_SWITCH", "ASK_WORK:partial_work", "HINT_TEACH", "RETRY_FULL"], dict(turns=8),
    ),
    "vague, then a demand": ([dict(type="VAGUE", saw_last=False), dict(type="DEMAND", saw_last=False)], ["CLARIFY", "HINT_POINT"], dict(help_level=1)),
    "fifteen turns": ([dict(type="CONCEPT")] * 15, ["ANSWER_CONCEPT"] * 14 + ["PARK"], dict(park_reason="turn_limit")),
    "back from rest": ([*[{}] * 5, dict(saw_last=False)], ["HINT_POINT", "HINT_TEACH", "DEMO_SIMILAR", "PREREQ_REVIEW", "PARK", "PREREQ_REVIEW"], dict(phase="REMEDIATING", turns=1)),
    "faults give no more help": ([{}, dict(fault=True), dict(fault=True)], ["HINT_POINT", "HINT_POINT", "HINT_POINT"], dict(turns=1, stall=1)),
    "a card that was not shown": ([dict(shown=False), {}], ["HINT_POINT", "HINT_POINT"], dict(help_level=0)),
}


@pytest.mark.parametrize("name", SESSIONS)
def test_sessions(name):
    turns, want, state = SESSIONS[name]
    cards, lesson = play(*turns)
    assert cards == want
    assert {k: getattr(lesson, k) for k in state} == state


def random_turn(r):
    return dict(
        type=r.choice([*fixed.TURN_ORDER[:-2], "ANSWER", "ANSWER", "PARTIAL", "HELP"]).replace("DISTRESS", "HELP"), safety=r.random() < 0.01, fault=r.random() < 0.1, valid=r.random() < 0.9,
        tool=r.choice(["correct", "incorrect", "absent", "unknown"]), verdict=r.choice([*fixed.LADDERS, "CORRECT", "CORRECT"]), source=r.choice(["tool", "model", "none"]), has_work=r.random() < 0.5,
        saw_last=r.random() < 0.8, gap_improved=r.random() < 0.1, error_at=r.choice([None, 0, 1, 2]), gap=r.choice([None, "a", "b"]), explanation=r.choice(["none", "sound", "weak", "contradicts"]),
        said=r.choice([None, "D0", "CORRECT"]), no_example=r.random() < 0.3, no_prerequisite=r.random() < 0.3, transfers=r.randrange(4),
    )


def test_limits_hold_in_any_session():
    r = random.Random(9)
    cards = {c[0] for c in fixed.CARDS}
    for _ in range(200):
        lesson = Lesson()
        for _ in range(40):
            before = dataclasses.replace(lesson)
            (card,), lesson = play(random_turn(r), lesson=lesson)
            assert card.split(":")[0] in cards and lesson.turns <= lessons.MAX_TURNS and lesson.stall <= lessons.MAX_STALL
            assert lesson.problem <= lessons.TRANSFERS and lesson.guesses < lessons.GUESSES + 2 and 0 <= lesson.help_level <= 6
            assert (lesson.phase == "PARKED") == (lesson.park_reason is not None)
            assert before.phase != "RESOLVED" or lesson.phase == "RESOLVED" or card == "SAFETY_STOP"


def test_state_fits_its_schema(spark):
    from pyspark.sql.types import StructType

    assert StructType.fromDDL(lessons.fields_of_lesson()).names == [f.name for f in dataclasses.fields(Lesson)]
    assert Lesson(*lessons.packed(Lesson(gap="a"))) == Lesson(gap="a")


def turns_of(spark, sessions=6, n=30):
    import datetime

    r = random.Random(12)
    rows = []
    for s in range(sessions):
        for i in range(n):
            t = {**PLAIN, **random_turn(r), "session_id": s, "turn_id": s * 1000 + i, "ts": datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i)}
            rows.append(tuple(t[c.split()[0]] for c in lessons.TURN.split(", ")))
    return spark.createDataFrame(rows, lessons.TURN)


def test_stream_equals_batch_in_any_cut(spark, tmp_path):
    turns = turns_of(spark)
    want = sorted(map(repr, lessons.chosen(turns).collect()))
    early, later = turns.where("turn_id % 1000 < 13"), turns.where("turn_id % 1000 >= 13")
    early.coalesce(1).write.parquet(str(tmp_path / "in"))
    later.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    with stream.rocks(spark):
        source = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        got = available(stream.chosen(source))
    assert sorted(map(repr, got.collect())) == want


def test_deadlines(spark, tmp_path):
    import datetime

    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    given = [(1, 10, at(0), False), (1, 11, at(5), True), (2, 20, at(0), False), (2, 21, at(100), True), (3, 30, at(0), False), (4, 40, at(200), True)]
    rows = [tuple({**PLAIN, "session_id": s, "turn_id": t, "ts": ts, "shown": shown}[c.split()[0]] for c in lessons.TURN.split(", ")) for s, t, ts, shown in given]
    turns = spark.createDataFrame(rows, lessons.TURN)
    turns.coalesce(1).write.parquet(str(tmp_path / "in"))
    with stream.rocks(spark):
        got = available(stream.chosen(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in"))))
    found = {(r.turn_id, r.status): r.card for r in got.collect()}
    assert set(found) == {(10, "waiting"), (11, "shown"), (20, "waiting"), (20, "late"), (21, "shown"), (30, "waiting"), (30, "late"), (40, "shown")}
    assert found[11, "shown"] == "HINT_TEACH"  # seen: the ladder goes on
    assert found[21, "shown"] == "HINT_POINT"  # late: the card counts as not shown


def test_queries_agree(spark):
    from lectern.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    batch = QUERIES["z03_decided"](spark, sf)
    want = sorted(map(repr, batch.collect()))
    assert sorted(map(repr, QUERIES["z03_decided_stream"](spark, sf).collect())) == want and len({r.card for r in batch.collect()}) >= 12
