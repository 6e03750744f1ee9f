"""Queries of tutoring state: conversations as sessions, events as traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import tutor
from .base import query, table

_LIKE = lambda words: "(" + " OR ".join("contains(low, '" + w.replace("'", "''") + "')" for w in words) + ")"
_OPENS = "(" + " OR ".join("starts_with(low, '" + w.replace("'", "''") + "')" for w in fixed.QUESTION_OPENINGS) + ")"
_TURNS = rf"""u AS (SELECT conv_id, turn, text, lower(trim(text, E' \t\n\r')) AS low, row_number() OVER (PARTITION BY conv_id ORDER BY turn) > 1 AS has_history, regexp_matches(text, '[=+\-*/^∫∂∑∏]|\d') AS math FROM conversations WHERE role = 'user'),
tt AS (SELECT *, CASE WHEN {_LIKE(fixed.HELP_MARKERS)} THEN 'HELP' WHEN len(list_filter(regexp_split_to_array(low, '\s+'), lambda w: w <> '')) < 4 AND NOT math THEN 'VAGUE' WHEN {_LIKE(fixed.REASON_MARKERS)} THEN 'REASONING' WHEN math OR {_LIKE(fixed.MATH_WORDS)} THEN 'ATTEMPT' WHEN {_OPENS} THEN 'NEW_QUESTION' WHEN has_history THEN 'ATTEMPT' ELSE 'VAGUE' END AS turn_type FROM u)"""


@query(f"WITH {_TURNS} SELECT conv_id, turn, has_history, turn_type FROM tt")
def u01_turn_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tutor.session_turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "has_history", "turn_type")


@query(f"""WITH {_TURNS}, n AS (SELECT *, coalesce(count_if(turn_type = 'HELP') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tt)
SELECT conv_id, turn, turn_type, CASE turn_type WHEN 'HELP' THEN CASE WHEN before = 0 THEN 'hint' ELSE 'explain' END WHEN 'VAGUE' THEN CASE WHEN has_history THEN 'clarify' ELSE 'probe' END WHEN 'REASONING' THEN 'check_understanding' WHEN 'NEW_QUESTION' THEN 'redirect' ELSE CASE WHEN has_history THEN 'retry' ELSE 'probe' END END AS action,
 least(3, before + (turn_type = 'HELP')::INT)::INT AS help_level, 0 AS stall FROM n""")
def w07_policy_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = tutor.session_turns(table(spark, sf_dir, "conversations"))
    return tutor.folded(turns.select("conv_id", "turn", "turn_type", F.lit("UNCLEAR").alias("diagnosis"), F.lit(False).alias("correct"), F.lit(True).alias("delivered")))


_ACTION = """CASE WHEN solved THEN 'wrap_up' WHEN correct THEN 'confirm' WHEN turn_type = 'HELP' THEN CASE WHEN help = 0 THEN 'hint' ELSE 'explain' END WHEN turn_type = 'VAGUE' THEN CASE WHEN seen THEN 'clarify' ELSE 'probe' END
WHEN turn_type = 'REASONING' THEN 'check_understanding' WHEN turn_type = 'NEW_QUESTION' THEN 'redirect' WHEN dx = 'D0' THEN 'probe' WHEN dx = 'D1' THEN 'address_misconception' WHEN dx = 'D4' THEN 'nudge_calculation' WHEN dx = 'D5' THEN 'check_understanding'
WHEN dx = 'D2' THEN CASE WHEN stalled >= 2 THEN 'explain' ELSE 'redirect' END WHEN dx = 'D3' THEN 'prereq_check' WHEN stalled >= 2 THEN CASE WHEN help = 0 THEN 'hint' ELSE 'explain' END WHEN NOT seen THEN 'probe' ELSE 'retry' END"""
_LEVEL = """CASE WHEN solved OR correct OR turn_type IN ('VAGUE', 'REASONING', 'NEW_QUESTION') THEN help WHEN turn_type = 'HELP' THEN least(3, help + 1) WHEN dx IN ('D0', 'D4', 'D5') THEN help WHEN dx = 'D1' THEN greatest(help, 1)
WHEN dx IN ('D2', 'D3') OR stalled >= 2 THEN least(3, help + 1) ELSE help END"""


@query(f"""WITH RECURSIVE {_TURNS}, d AS (SELECT conv_id, turn, turn_type, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, ['D0', 'D1', 'D2', 'D3', 'D4', 'D5', 'UNCLEAR', 'D2', 'D2'][(conv_id * 5 + turn) % 9 + 1] AS dx, turn % 11 = 10 AS correct, turn % 4 <> 2 AS shown FROM tt),
f AS (SELECT DISTINCT conv_id, NULL::BIGINT AS turn, NULL::VARCHAR AS turn_type, 0::BIGINT AS n, NULL::VARCHAR AS action, 0 AS level, 0 AS stalled, 0 AS help, false AS solved, false AS seen FROM d
UNION ALL SELECT conv_id, turn, turn_type, n, action, level, CASE WHEN turn_type = 'HELP' OR dx = 'D5' THEN 0 WHEN turn_type = 'ATTEMPT' AND dx <> 'UNCLEAR' THEN stalled + 1 ELSE stalled END, CASE WHEN shown THEN level ELSE help END, solved OR (shown AND correct), true FROM
(SELECT *, {_ACTION} AS action, {_LEVEL} AS level FROM (SELECT d.*, f.stalled, f.help, f.solved, f.seen FROM f JOIN d ON d.conv_id = f.conv_id AND d.n = f.n + 1)))
SELECT conv_id, turn, turn_type, action, level AS help_level, stalled AS stall FROM f WHERE n > 0""")
def w07_policy_fold_diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole policy with injected diagnoses and some undelivered actions."""
    turns = tutor.session_turns(table(spark, sf_dir, "conversations"))
    names = F.array(*[F.lit(x) for x in ("D0", "D1", "D2", "D3", "D4", "D5", "UNCLEAR", "D2", "D2")])
    diagnosis = F.element_at(names, (F.pmod(F.col("conv_id") * 5 + F.col("turn"), F.lit(9)) + 1).cast("int"))
    return tutor.folded(turns.select("conv_id", "turn", "turn_type", diagnosis.alias("diagnosis"), (F.col("turn") % 11 == 10).alias("correct"), (F.col("turn") % 4 != 2).alias("delivered")))


@query("SELECT conv_id, turn, parent_turn, response_to FROM (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent_turn, (SELECT max(b.turn) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn < a.turn AND b.role = 'assistant') AS response_to FROM conversations a WHERE role = 'user')")
def j20_turn_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tutor.lineage(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id AS session_id, turn AS action_id FROM conversations a WHERE role = 'assistant' AND EXISTS (SELECT 1 FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'user')")
def u05_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    actions = c.where("role = 'assistant'").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("action_id"))
    seen = c.where("role = 'user'").select(F.col("conv_id").alias("session_id"), (F.col("turn") - 1).alias("action_id"), F.lit("presented").alias("status"))
    return tutor.committed(actions, seen)


@query("SELECT conv_id AS session_id, turn % 3 AS gap_id, ['open', 'partial', 'closed'][max(CASE WHEN contains(text, q) AND q <> '' THEN CASE turn % 5 WHEN 4 THEN 2 WHEN 3 THEN 1 ELSE 0 END ELSE 0 END) + 1] AS status FROM (SELECT *, CASE WHEN turn % 2 = 0 THEN text[1:10] ELSE 'not said' END AS q FROM conversations) GROUP BY ALL")
def u04_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("turn")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), (t % 3).alias("gap_id"), F.when(t % 5 == 4, "closed").when(t % 5 == 3, "partial").otherwise("open").alias("status"), F.when(t % 2 == 0, F.substring("text", 1, 10)).otherwise("not said").alias("quote"), F.col("text").alias("student_text"))
    return tutor.gap_status(rows)


@query("SELECT conv_id, turn, CASE WHEN " + _LIKE(fixed.HELP_MARKERS) + " THEN 'explain' ELSE 'probe' END AS action, " + _LIKE(fixed.HELP_MARKERS) + " AS retrieve FROM (SELECT *, lower(text) AS low FROM conversations WHERE role = 'user')")
def u06_initial_engine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tutor.session_turns(table(spark, sf_dir, "conversations"))
    helped = F.col("turn_type") == "HELP"
    return rows.select("conv_id", "turn", F.when(helped, "explain").otherwise("probe").alias("action"), helped.alias("retrieve"))


@query("SELECT a.event_id, concat_ws(' ', CASE WHEN a.user_id <> b.user_id THEN 'user_id' END, CASE WHEN a.event_type <> b.event_type THEN 'event_type' END, CASE WHEN a.props <> b.props THEN 'props' END) AS mismatches FROM events a JOIN events b ON b.event_id = a.event_id + 1")
def u07_linked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    b = e.select((F.col("event_id") - 1).alias("event_id"), *[F.col(c).alias(f"b_{c}") for c in ("user_id", "event_type", "props")])
    wrong = F.array_compact(F.array(*[F.when(F.col(c) != F.col(f"b_{c}"), F.lit(c)) for c in ("user_id", "event_type", "props")]))
    return e.join(b, "event_id").select("event_id", F.array_join(wrong, " ").alias("mismatches"))


@query("SELECT doc_id, CASE WHEN doc_id % 6 < 2 OR lang = 'es' THEN 'partial' WHEN n_chars % 3 > 0 THEN 'confirmation_required' ELSE 'recognized' END AS status, (doc_id % 2 = 0 OR contains(text, CASE WHEN doc_id % 3 = 0 THEN text[1:5] ELSE '#none#' END)) AS confirmable FROM documents")
def u08_u09_handwriting(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    status = tutor.handwriting_status(F.lit(6), F.when(n % 6 < 2, 5).otherwise(6), F.when(F.col("lang") == "es", "partial").otherwise("recognized"), F.col("n_chars") % 3)
    reading = F.struct((n % 2 != 0).alias("meaning_may_change"), F.when(n % 3 == 0, F.substring("text", 1, 5)).otherwise("#none#").alias("resolution"))
    return table(spark, sf_dir, "documents").select("doc_id", status.alias("status"), tutor.confirmable(F.array(reading), F.col("text")).alias("confirmable"))


@query("SELECT user_id AS session_id, event_id, round(sum(cost) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 6) AS running FROM (SELECT *, (event_id % 97) / 1000.0::DOUBLE AS cost FROM events)")
def a11_running_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), "event_id", "ts", (F.col("event_id") % 97 / 1000.0).alias("cost"))
    return tutor.running_cost(rows).select("session_id", "event_id", F.round("running", 6).alias("running"))


@query("SELECT user_id AS session_id, event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, CASE WHEN length(string_agg(props, ' ' ORDER BY event_id)) > 360 THEN rtrim(string_agg(props, ' ' ORDER BY event_id)[:359]) || '…' ELSE string_agg(props, ' ' ORDER BY event_id) END AS summary FROM events WHERE event_type IN ('click', 'view', 'error') GROUP BY ALL")
def u12_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view", "error"))
    by = e.groupBy(F.col("user_id").alias("session_id"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.array_sort(F.collect_list(F.struct("event_id", "props"))).alias("p"))
    return by.select("session_id", "event_type", "n", "first_ts", "last_ts", text.bounded(F.array_join(F.transform("p", lambda x: x["props"]), " ")).alias("summary"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN props END AS diagnostic, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS operational FROM events")
def u13_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    fault = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select("event_id", F.when(fault, F.col("props")).alias("diagnostic"), F.when(~fault, F.col("value")).alias("operational"))


@query("SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 8")
def w08_history_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.retrieve import top

    return top(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn")], 8).select("conv_id", "turn", "text")
