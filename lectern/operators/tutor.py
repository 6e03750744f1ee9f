"""Tutoring state: turn types, the action policy as a fold over a session's turns, commits, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text

_STATE = "struct<help:int,stall:int,solved:boolean,seen:boolean,out:array<struct<turn:bigint,turn_type:string,action:string,help_level:int,stall:int>>>"


def session_turns(conversations: DataFrame) -> DataFrame:
    """Student turns with the session's history flag and turn type."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    users = conversations.where("role = 'user'").withColumn("has_history", F.row_number().over(order) > 1)
    return users.withColumn("turn_type", text.turn_type(F.coalesce("text", F.lit("")), F.col("has_history")))


def decide(s: Column, kind: Column, diagnosis: Column, correct: Column) -> tuple[Column, Column, Column]:
    """(action, help level, solved) for a turn in state s; the first rule that holds wins."""
    up = F.least(s["help"] + 1, F.lit(3))
    stalled = s["stall"] >= 2
    rules = [
        (s["solved"], "wrap_up", s["help"], True),
        (correct | (diagnosis == "CORRECT"), "confirm", s["help"], True),
        ((kind == "HELP") & (s["help"] == 0), "hint", F.lit(1), False),
        (kind == "HELP", "explain", up, False),
        ((kind == "VAGUE") & ~s["seen"], "probe", s["help"], False),
        (kind == "VAGUE", "clarify", s["help"], False),
        (kind == "REASONING", "check_understanding", s["help"], False),
        (kind == "NEW_QUESTION", "redirect", s["help"], False),
        (diagnosis == "D0", "probe", s["help"], False),
        (diagnosis == "D1", "address_misconception", F.greatest(s["help"], F.lit(1)), False),
        (diagnosis == "D4", "nudge_calculation", s["help"], False),
        (diagnosis == "D5", "check_understanding", s["help"], False),
        ((diagnosis == "D2") & stalled, "explain", up, False),
        (diagnosis == "D2", "redirect", up, False),
        (diagnosis.isin("D3", "D6", "D7"), "prereq_check", up, False),
        (stalled & (s["help"] == 0), "hint", F.lit(1), False),
        (stalled, "explain", up, False),
        (~s["seen"], "probe", s["help"], False),
    ]
    action, level, solved = F.lit("retry"), s["help"], F.lit(False)
    for test, a, h, d in reversed(rules):
        test = F.coalesce(test, F.lit(False))
        action, level, solved = F.when(test, a).otherwise(action), F.when(test, h).otherwise(level), F.when(test, F.lit(d)).otherwise(solved)
    return action, level, solved


def folded(turns: DataFrame) -> DataFrame:
    """Actions of every session: a fold over its turns (conv_id, turn, turn_type, diagnosis, correct, delivered).

    A session is a bounded list of turns. What is not delivered leaves the help level as it was.
    """
    items = F.array_sort(F.collect_list(F.struct("turn", "turn_type", "diagnosis", "correct", "delivered")))
    start = F.from_json(F.lit('{"help":0,"stall":0,"solved":false,"seen":false,"out":[]}'), _STATE)

    def step(s: Column, x: Column) -> Column:
        action, level, solved = decide(s, x["turn_type"], x["diagnosis"], x["correct"])
        reset = (x["turn_type"] == "HELP") | x["diagnosis"].isin("CORRECT", "D5")
        real = (x["turn_type"] == "ATTEMPT") & (x["diagnosis"] != "UNCLEAR")
        stall = F.when(F.coalesce(reset, F.lit(False)), 0).when(F.coalesce(real, F.lit(False)), s["stall"] + 1).otherwise(s["stall"])
        row = F.struct(x["turn"].alias("turn"), x["turn_type"].alias("turn_type"), action.alias("action"), level.cast("int").alias("help_level"), stall.cast("int").alias("stall"))
        kept = x["delivered"]
        return F.struct(F.when(kept, level).otherwise(s["help"]).cast("int").alias("help"), stall.cast("int").alias("stall"), F.when(kept, solved | s["solved"]).otherwise(s["solved"]).alias("solved"), F.lit(True).alias("seen"), F.concat(s["out"], F.array(row)).alias("out")).cast(_STATE)

    return turns.groupBy("conv_id").agg(F.aggregate(items, start, step)["out"].alias("out")).select("conv_id", F.explode("out").alias("x")).select("conv_id", "x.*")


def lineage(conversations: DataFrame) -> DataFrame:
    """Each student turn with the turn it follows and the assistant's action before it."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    acted = F.last(F.when(F.col("role") == "assistant", F.col("turn")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = conversations.withColumn("response_to", acted).where("role = 'user'")
    return rows.select("conv_id", "turn", F.lag("turn").over(order).alias("parent_turn"), "response_to")


def committed(actions: DataFrame, deliveries: DataFrame) -> DataFrame:
    """Pending actions (session_id, action_id) that a delivery presented."""
    ok = deliveries.where(F.col("status").isin("presented", "partially_presented")).select("session_id", "action_id").distinct()
    return actions.join(ok, ["session_id", "action_id"], "left_semi")


def running_cost(events: DataFrame) -> DataFrame:
    """Cost so far of every session, eight decimals."""
    w = Window.partitionBy("session_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("running", F.round(F.sum("cost").over(w), 8))


def handwriting_status(pages: Column, processed: Column, said: Column, meaning: Column) -> Column:
    return F.when((processed < pages) | (said == "partial"), "partial").when(meaning > 0, "confirmation_required").otherwise(said)


def confirmable(ambiguities: Column, confirmed: Column) -> Column:
    """True if every reading that changes the meaning has a resolution that stands in the confirmed text."""
    return F.forall(ambiguities, lambda a: ~a["meaning_may_change"] | (F.coalesce(F.trim(a["resolution"]) != "", F.lit(False)) & F.contains(confirmed, a["resolution"])))


def gap_status(updates: DataFrame) -> DataFrame:
    """The furthest status of each gap; an update counts only if its quote stands in the student's text."""
    rank = F.when(F.col("status") == "closed", 2).when(F.col("status") == "partial", 1).otherwise(0)
    ok = F.contains("student_text", F.col("quote")) & (F.col("quote") != "")
    best = updates.groupBy("session_id", "gap_id").agg(F.max(F.when(ok, rank).otherwise(0)).alias("r"))
    return best.select("session_id", "gap_id", F.element_at(F.array(F.lit("open"), F.lit("partial"), F.lit("closed")), F.col("r") + 1).alias("status"))
