"""Queries of the specified choice of cards: sessions of events, in batch and as a stream, beside one recursive query that folds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import lessons
from ..streaming import lessons as lesson_stream
from ..streaming.runs import available
from .base import query, quoted, table
from .dialogue import _RULES
from .streams import events

_KINDS = ("ANSWER", "HELP", "PARTIAL", "CONCEPT", "DEMAND", "VAGUE", "OFF_TOPIC", "NEW_QUESTION")
_MODEL = ("D0", "D1", "D3", "D5", "D6", "CORRECT", "UNCLEAR")

#: The turns of `_turns`, numbered inside their session.
_TURNS_SQL = f"""e AS (SELECT user_id AS sid, event_id AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
  CASE event_type WHEN 'purchase' THEN 'ANSWER' WHEN 'signup' THEN 'ACK' ELSE [{quoted(_KINDS)}][event_id // 3 % 8 + 1] END AS type, event_id % 211 = 0 AS safety, event_id % 13 = 0 AS fault, event_id % 17 <> 0 AS valid,
  ['correct', 'incorrect', 'absent', 'unknown'][event_id // 5 % 4 + 1] AS tool, event_id % 29 = 0 AS mc, [{quoted(_MODEL)}][event_id // 2 % 7 + 1] AS model, ['high', 'medium', 'low'][event_id // 11 % 3 + 1] AS conf,
  coalesce(value > 30, false) AS work, event_id % 4 <> 0 AS saw, event_id % 19 = 0 AS better, CASE WHEN event_id % 3 = 0 THEN event_id % 5 ELSE -1 END AS spot,
  CASE WHEN event_id % 2 = 0 THEN ['method', 'prerequisite'][event_id // 40 % 2 + 1] END AS aim, ['none', 'sound', 'weak', 'contradicts'][event_id // 7 % 4 + 1] AS expl,
  user_id % 3 = 0 AS bare, user_id % 5 = 0 AS nopre, user_id % 4 AS more FROM events),
t AS (SELECT *, split_part({_RULES}, '|', 1) AS verdict, split_part({_RULES}, '|', 2) AS source FROM e)"""

_LADDER = "CASE {} " + " ".join(f"WHEN '{k}' THEN [{quoted(v)}]" for k, v in fixed.LADDERS.items()) + " ELSE ['PARK'] END"
_ASSISTS = quoted([c[0] for c in fixed.CARDS if c[3]])
_COUNTS = quoted(sorted({c for row in fixed.LADDERS.values() for c in row}))
_ASIDES = "CASE type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lessons.ASIDE.items()) + " END"

#: One turn: columns over the state before it (ph, pr, tu, ...) and the turn's own, in layers.
_LAYERS = [
    f"""saw AND coalesce(lc IN ({_ASSISTS}), false) OR helped AS helped1, safety OR coalesce(pr = 'safety', false) AS stop""",
    """NOT stop AND (ph = 'RESOLVED' OR coalesce(pr = 'no_transfer_available', false)) AS fin""",
    """NOT stop AND NOT fin AS live, NOT stop AND NOT fin AND ph = 'PARKED' AS back""",
    """CASE WHEN live THEN CASE WHEN back THEN 0 ELSE tu END + (NOT fault)::INT ELSE tu END AS tu1, CASE WHEN back THEN 0 ELSE st END AS st1, CASE WHEN back THEN greatest(0, hl - 1) ELSE hl END AS hl1,
    CASE WHEN NOT back THEN pr END AS pr1, CASE WHEN NOT back THEN lc END AS lc1, CASE WHEN NOT back THEN ph WHEN solved THEN 'SOLVED_CHECK' ELSE 'REMEDIATING' END AS ph1""",
    f"""CASE WHEN stop THEN 'stop' WHEN fin THEN 'fin' WHEN NOT valid THEN 'partial' WHEN type = 'NEW_QUESTION' THEN 'new' WHEN {_ASIDES} IS NOT NULL THEN 'aside'
    WHEN ph1 = 'SOLVED_CHECK' THEN CASE WHEN expl = 'contradicts' THEN 'fell' WHEN expl = 'sound' OR ck + 1 >= {lessons.CHECKS} THEN 'on' ELSE 'again' END WHEN type = 'ACK' THEN 'ack' ELSE 'try' END AS way""",
    """way = 'try' AND type IN ('ANSWER', 'PARTIAL') AS tries""",
    """tries AND verdict = 'CORRECT' AS win, tries AND verdict <> 'CORRECT' AND ph1 = 'TRANSFER' AND tool = 'incorrect' AS miss""",
    f"""ms + miss::INT AS ms1, miss AND ms + 1 >= {lessons.TRANSFERS} AS spent, win AND ph1 = 'TRANSFER' AND source = 'tool' AND NOT helped1 AS won""",
    """way = 'try' AND NOT win AND NOT spent AND NOT fault AS aid""",
    """aid AND (better OR (spot > ea AND ea >= 0)) AS moved, aid AND coalesce(aim <> gap, false) AS other""",
    """CASE WHEN NOT aid THEN st1 WHEN moved THEN 0 ELSE st1 + saw::INT END AS st2, CASE WHEN aid THEN greatest(ea, spot) ELSE ea END AS ea1, CASE WHEN aid THEN coalesce(aim, gap) ELSE gap END AS gap1,
    CASE WHEN NOT aid THEN hl1 ELSE greatest((type = 'DEMAND')::INT, CASE WHEN moved OR other THEN 0 ELSE hl1 + (saw AND counts)::INT END) END AS hl2""",
    f"""aid AND st2 >= {lessons.MAX_STALL} AS stuck""",
    """way = 'try' AND NOT win AND NOT spent AND NOT stuck AS climbs""",
    f"""CASE WHEN climbs THEN CASE WHEN tries THEN verdict ELSE coalesce(dx, 'D0') END WHEN way = 'fell' THEN CASE WHEN model IN ({quoted(tuple(fixed.LADDERS))}) THEN model ELSE 'UNCLEAR' END ELSE dx END AS dx1,
    CASE WHEN NOT climbs THEN gu WHEN type = 'ANSWER' AND tool = 'incorrect' AND NOT work THEN gu + 1 WHEN work THEN 0 ELSE gu END AS gu1, CASE WHEN way = 'fell' THEN 0 ELSE hl2 END AS hl3""",
    f"""climbs AND gu1 >= {lessons.GUESSES} AND lc1 IS DISTINCT FROM 'ASK_WORK' AS guess""",
    """climbs AND NOT guess AND type = 'VAGUE' AND hl3 = 0 AND lc1 IS DISTINCT FROM 'CLARIFY' AS vague""",
    f"""(climbs AND NOT guess AND NOT vague) OR way = 'fell' AS rung, {_LADDER.format("dx1")} AS rungs""",
    """least(hl3, len(rungs) - 1) AS low""",
    """list_filter(range(0, len(rungs)), lambda i: i >= low AND (rungs[i + 1] = 'PARK' OR (NOT (bare AND rungs[i + 1] = 'DEMO_SIMILAR') AND NOT (nopre AND rungs[i + 1] IN ('PREREQ_CHECK', 'PREREQ_REVIEW'))
    AND (fault OR rungs[i + 1] IS DISTINCT FROM lc1))))[1] AS step, way = 'on' AND pb < least(2, more) AS onward""",
    f"""CASE way WHEN 'stop' THEN 'SAFETY_STOP' WHEN 'fin' THEN CASE type WHEN 'CONCEPT' THEN 'ANSWER_CONCEPT' WHEN 'NEW_QUESTION' THEN 'CONFIRM_SWITCH' ELSE 'REDIRECT' END WHEN 'partial' THEN 'ASK_WORK' WHEN 'new' THEN 'CONFIRM_SWITCH'
    WHEN 'aside' THEN {_ASIDES} WHEN 'ack' THEN CASE WHEN att THEN 'RETRY_FULL' ELSE 'ELICIT_START' END WHEN 'on' THEN CASE WHEN onward THEN 'TRANSFER' ELSE 'WRAP_UP' END
    WHEN 'again' THEN CASE WHEN lv = 'D8' AND NOT work THEN 'ASK_WORK' ELSE 'CONFIRM_ASK_WHY' END
    ELSE CASE WHEN won THEN 'WRAP_UP' WHEN win THEN CASE WHEN helped1 OR work THEN 'CONFIRM_ASK_WHY' ELSE 'ASK_WORK' END WHEN spent OR stuck THEN 'PARK' WHEN guess THEN 'ASK_WORK' WHEN vague THEN 'CLARIFY' ELSE rungs[step + 1] END END AS card0,
    CASE WHEN way = 'stop' THEN 'PARKED' WHEN way = 'fell' THEN 'REMEDIATING' WHEN way = 'on' THEN CASE WHEN onward THEN 'TRANSFER' ELSE 'PARKED' END WHEN won THEN 'RESOLVED' WHEN win THEN 'SOLVED_CHECK'
    WHEN climbs AND ph1 IN ('ATTEMPTING', 'TRANSFER') THEN 'REMEDIATING' ELSE ph1 END AS ph2,
    CASE WHEN way = 'stop' THEN 'safety' WHEN way = 'on' AND NOT onward THEN 'no_transfer_available' WHEN spent THEN 'transfer_budget' WHEN stuck THEN 'stall' ELSE pr1 END AS pr2,
    CASE WHEN win THEN main OR pb = 0 WHEN way = 'fell' THEN main AND pb <> 0 ELSE main END AS main1, pb + onward::INT AS pb1""",
    f"""live AND tu1 >= {lessons.MAX_TURNS} AND card0 <> 'WRAP_UP' AS beyond""",
    """CASE WHEN beyond THEN CASE WHEN main1 AND pb1 = 0 THEN 'WRAP_UP' ELSE 'PARK' END ELSE card0 END AS card,
    CASE WHEN way = 'partial' THEN 'partial_work' WHEN way = 'aside' AND type = 'OFF_TOPIC' THEN 'off_topic' WHEN way = 'fin' AND card0 = 'REDIRECT' THEN 'question_done' END AS variant""",
]
_START = (
    "'ATTEMPTING' AS ph, NULL::VARCHAR AS pr, 0 AS tu, 0 AS hl, 0 AS st, 0 AS gu, 0 AS ck, 0 AS pb, 0 AS ms, false AS solved, false AS main, false AS att, false AS helped, -1 AS ea, "
    "NULL::VARCHAR AS gap, NULL::VARCHAR AS dx, NULL::VARCHAR AS lv, NULL::VARCHAR AS lc, false AS counts"
)
_AFTER = f"""CASE WHEN beyond OR (live AND card0 = 'PARK') THEN 'PARKED' ELSE ph2 END AS ph, CASE WHEN beyond THEN 'turn_limit' WHEN live AND card0 = 'PARK' THEN coalesce(pr2, 'ladder_end') ELSE pr2 END AS pr, tu1 AS tu,
CASE WHEN onward THEN 0 WHEN rung AND step <> low THEN step ELSE hl3 END AS hl, CASE WHEN onward THEN 0 ELSE st2 END AS st, CASE WHEN onward OR guess THEN 0 ELSE gu1 END AS gu,
CASE WHEN win AND NOT won THEN 0 WHEN way = 'again' THEN ck + 1 ELSE ck END AS ck, pb1 AS pb, ms1 AS ms, CASE WHEN win THEN true WHEN way = 'fell' OR onward THEN false ELSE solved END AS solved, main1 AS main,
NOT onward AND (att OR tries) AS att, NOT onward AND helped1 AS helped, CASE WHEN onward THEN -1 ELSE ea1 END AS ea, CASE WHEN NOT onward THEN gap1 END AS gap, CASE WHEN NOT onward THEN dx1 END AS dx,
CASE WHEN win AND NOT won THEN CASE WHEN helped1 THEN 'D9' WHEN work THEN 'D10' ELSE 'D8' END ELSE lv END AS lv, card AS lc, card IN ({_COUNTS}) AS counts"""


def _folded_sql() -> str:
    turn = "SELECT s.* EXCLUDE (sid, n, k, card, variant), t.* FROM s JOIN t ON t.sid = s.sid AND t.n = s.n + 1"
    for layer in _LAYERS:
        turn = f"SELECT *, {layer} FROM ({turn})"
    return f"""WITH RECURSIVE {_TURNS_SQL},
s AS (SELECT DISTINCT sid, 0::BIGINT AS n, NULL::BIGINT AS k, NULL::VARCHAR AS card, NULL::VARCHAR AS variant, {_START} FROM t
UNION ALL SELECT sid, n, k, card, variant, {_AFTER} FROM ({turn}))
SELECT sid AS session_id, k AS turn_id, card, variant, ph AS phase, pr AS park_reason, hl AS help_level, st AS stall, gu AS guesses, pb AS problem, lv AS level, 'shown' AS status FROM s WHERE n > 0"""


def _turns(e: DataFrame) -> DataFrame:
    """Every event as a turn of its user's session; what the turn shows follows from its number and kind."""
    k = F.col("event_id")
    pick = lambda names, by: F.element_at(F.array(*[F.lit(x) for x in names]), (by % len(names) + 1).cast("int"))
    kind = F.when(F.col("event_type") == "purchase", "ANSWER").when(F.col("event_type") == "signup", "ACK").otherwise(pick(_KINDS, F.floor(k / 3)))
    turns = e.select(
        F.col("user_id").alias("session_id"), k.alias("turn_id"), "ts", F.array(kind).alias("intents"), (k % 211 == 0).alias("safety"), (k % 13 == 0).alias("fault"), (k % 17 != 0).alias("valid"),
        pick(("correct", "incorrect", "absent", "unknown"), F.floor(k / 5)).alias("tool"), (k % 29 == 0).alias("missing_constant"), pick(_MODEL, F.floor(k / 2)).alias("model"),
        pick(("high", "medium", "low"), F.floor(k / 11)).alias("confidence"), (F.col("value") > 30).alias("has_work"), (k % 4 != 0).alias("saw_last"), (k % 19 == 0).alias("gap_improved"),
        F.when(k % 3 == 0, (k % 5).cast("int")).alias("error_at"), F.when(k % 2 == 0, pick(("method", "prerequisite"), F.floor(k / 40))).alias("gap"), pick(("none", "sound", "weak", "contradicts"), F.floor(k / 7)).alias("explanation"),
        F.lit(True).alias("shown"), (F.col("user_id") % 3 == 0).alias("no_example"), (F.col("user_id") % 5 == 0).alias("no_prerequisite"), (F.col("user_id") % 4).alias("transfers"),
    )
    return lessons.prepared(turns)


@query(_folded_sql())
def z03_decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The specified engine's card for every turn, each session folded in order."""
    return lessons.chosen(_turns(table(spark, sf_dir, "events")))


@query(_folded_sql())
def z03_decided_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream with state variables and timers."""
    with lesson_stream.rocks(spark):
        return available(lesson_stream.chosen(_turns(events(spark, sf_dir))))
