"""Queries of the specified engine: turns, verdicts, ladders, phases, replies, deliveries and their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import dialogue
from .base import query, quoted, table


def _pick(xs: tuple, i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))


_INTENTS = f"list_filter([{quoted(fixed.TURN_ORDER)}], lambda x, i: (e * 7 + i * i) % 6 = 0)"


@query(f"SELECT event_id, CASE WHEN it[1] = 'DISTRESS' THEN 'HELP' ELSE it[1] END AS turn_type FROM (SELECT event_id, {_INTENTS.replace('e * 7', 'event_id * 7')} AS it FROM events)")
def z01_primary_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.filter(F.array(*[F.lit(t) for t in fixed.TURN_ORDER]), lambda x, i: (F.col("event_id") * 7 + (i + 1) * (i + 1)) % 6 == 0)
    return table(spark, sf_dir, "events").select("event_id", dialogue.primary_type(F.reverse(names)).alias("turn_type"))


_MODEL = ("D0", "D3", "D5", "D6", "D7", "CORRECT", "UNCLEAR", None)
_RULES = """CASE WHEN tool = 'correct' AND mc THEN 'D7|tool' WHEN model IS NULL AND tool = 'correct' THEN 'CORRECT|tool' WHEN model IS NULL THEN 'UNCLEAR|none' WHEN conf = 'low' THEN 'UNCLEAR|none'
 WHEN tool = 'correct' THEN CASE WHEN model IN ('CORRECT', 'D7') THEN model || '|tool' ELSE 'UNCLEAR|none' END WHEN tool = 'incorrect' THEN CASE WHEN model = 'CORRECT' THEN 'UNCLEAR|none' ELSE model || '|tool' END WHEN tool = 'absent' THEN CASE WHEN model = 'CORRECT' THEN 'UNCLEAR|none' ELSE model || '|none' END
 WHEN model = 'CORRECT' THEN CASE WHEN conf = 'high' THEN 'CORRECT|model' ELSE 'UNCLEAR|none' END WHEN model IN ('D5', 'D6') AND conf <> 'high' THEN 'UNCLEAR|none' ELSE model || '|model' END"""


@query(f"WITH r AS (SELECT event_id, ['correct', 'incorrect', 'absent', 'unknown'][event_id % 4 + 1] AS tool, event_id % 9 = 0 AS mc, ['D0', 'D3', 'D5', 'D6', 'D7', 'CORRECT', 'UNCLEAR', NULL][event_id // 4 % 8 + 1] AS model, ['low', 'medium', 'high'][event_id // 32 % 3 + 1] AS conf FROM events) SELECT event_id, split_part({_RULES}, '|', 1) AS verdict, split_part({_RULES}, '|', 2) AS source FROM r")
def z02_u16_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    v = dialogue.reconciled(_pick(("correct", "incorrect", "absent", "unknown"), k % 4), k % 9 == 0, _pick(_MODEL, F.floor(k / 4) % 8), _pick(("low", "medium", "high"), F.floor(k / 32) % 3))
    return table(spark, sf_dir, "events").select("event_id", v.alias("v")).select("event_id", "v.verdict", "v.source")


_PHASES, _EVENTS = ("ATTEMPTING", "REMEDIATING", "SOLVED_CHECK", "TRANSFER", "RESOLVED", "PARKED"), ("correct", "error", "ladder_end", "sound", "weak", "contradicts", "no_problem_left", "correct_with_help", "second_error")
_MOVES = "(VALUES " + ", ".join("(" + quoted(t) + ")" for t in fixed.TRANSITIONS) + ") m(phase, event, next, card)"


@query(f"""WITH t AS (SELECT event_id, [{quoted(_PHASES)}][event_id % 6 + 1] AS phase, [{quoted(_EVENTS)}][event_id // 6 % 9 + 1] AS event, event_id % 18 AS tc, event_id % 2 = 0 AS ms, event_id % 3 AS ap FROM events), j AS (SELECT t.*, next, card, tc >= 15 AND phase NOT IN ('RESOLVED', 'PARKED') AS lim FROM t LEFT JOIN {_MOVES} USING (phase, event))
SELECT event_id, CASE WHEN lim THEN 'PARKED' ELSE coalesce(next, phase) END AS next, CASE WHEN lim THEN CASE WHEN ms AND ap = 0 THEN 'WRAP_UP' ELSE 'PARK' END ELSE coalesce(card, 'REDIRECT') END AS card FROM j""")
def z04_phase_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    t = table(spark, sf_dir, "events").select("event_id", _pick(_PHASES, k % 6).alias("phase"), _pick(_EVENTS, F.floor(k / 6) % 9).alias("event"), (k % 18).alias("turn_count"), (k % 2 == 0).alias("main_solved"), (k % 3).alias("active_problem"))
    return dialogue.transition(spark, t).select("event_id", "next", "card")


_LADDER = "CASE dx " + " ".join(f"WHEN '{k}' THEN [{quoted(v)}]" for k, v in fixed.LADDERS.items()) + f" ELSE [{quoted(fixed.LADDERS['D0'])}] END"
_SHOWN = ("HINT_POINT", "HINT_TEACH", "ASK_WORK", "DEMO_SIMILAR", None)


@query(f"""WITH r AS (SELECT event_id, CASE WHEN event_id % 10 < 9 THEN [{quoted(tuple(fixed.LADDERS))}][event_id % 10 + 1] END AS dx, event_id // 10 % 7 AS lv, ['HINT_POINT', 'HINT_TEACH', 'ASK_WORK', 'DEMO_SIMILAR', NULL][event_id // 70 % 5 + 1] AS last, CASE WHEN event_id % 4 = 0 THEN ['DEMO_SIMILAR', 'PREREQ_REVIEW'] ELSE [] END AS off FROM events), l AS (SELECT *, {_LADDER} AS ladder FROM r)
SELECT event_id, list_filter(ladder, lambda c, i: i > least(lv, len(ladder) - 1) AND (c = 'PARK' OR (NOT list_contains(off, c) AND NOT coalesce(c = last, false))))[1] AS card FROM l""")
def z05_ladder_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    diagnosis, off = F.when(k % 10 < 9, _pick(tuple(fixed.LADDERS), F.least(k % 10, F.lit(8)))), F.when(k % 4 == 0, F.array(F.lit("DEMO_SIMILAR"), F.lit("PREREQ_REVIEW"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "events").select("event_id", dialogue.ladder_card(diagnosis, F.floor(k / 10) % 7, _pick(_SHOWN, F.floor(k / 70) % 5), off).alias("card"))


_CARDS = "(VALUES " + ", ".join(f"('{c}', '{a}', '{s}', {str(x).lower()}, '{d}')" for c, a, s, x, d in fixed.CARDS) + ") c(card, action, search, assists, disclosure)"


@query(f"SELECT c.action, disclosure, count(*) AS n, count_if(assists)::BIGINT AS assisting FROM (SELECT [{quoted(tuple(c[0] for c in fixed.CARDS))}][event_id % 21 + 1] AS card FROM events) JOIN {_CARDS} USING (card) GROUP BY ALL")
def z06_action_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(_pick(tuple(c[0] for c in fixed.CARDS), F.col("event_id") % 21).alias("card"))
    return e.join(F.broadcast(dialogue.cards(spark)), "card").groupBy("action", "disclosure").agg(F.count(F.lit(1)).alias("n"), F.count_if("assists").alias("assisting"))  # 21 cards


_REPLY = "text || CASE turn % 4 WHEN 0 THEN ' so $y = 2 x$ ?' WHEN 1 THEN ' Why? And how? x = 3' WHEN 2 THEN ' The lecture notes say $x = 2$' ELSE ' see $ 2x $' END"


@query(rf"""WITH r AS (SELECT conv_id, turn, {_REPLY} AS reply, CASE WHEN conv_id % 2 = 0 THEN ['P1', 'P' || turn] ELSE [] END AS cites FROM conversations WHERE role = 'assistant' AND text IS NOT NULL), s AS (SELECT *, regexp_replace(reply, '\$[^$]*\$', ' ', 'g') AS outside, regexp_extract_all(reply, '\$([^$]*)\$', 1) AS inside FROM r)
SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN regexp_matches(outside, '[=^∫√]') THEN 'math_outside' END, CASE WHEN len(list_filter(inside, lambda m: NOT regexp_matches(m, '^\s*[a-zA-Z]\s*=') AND regexp_replace(lower(string_split(m, '=')[-1]), '\s+', '', 'g') = '2x')) > 0 THEN 'final_answer' END,
 CASE WHEN length(reply) - length(replace(reply, '?', '')) > 1 THEN 'questions' END, CASE WHEN len(list_filter(cites, lambda c: c NOT IN ('P1', 'P2', 'P3'))) > 0 THEN 'citation' END, CASE WHEN regexp_matches(reply, '(?i)\b(lecture|notes|textbook|course materials?)\b') AND len(cites) = 0 THEN 'unsupported_claim' END, CASE WHEN len(list_filter(regexp_split_to_array(reply, '\s+'), lambda w: w <> '')) > 120 THEN 'length' END], lambda x: x IS NOT NULL), ' ') AS problems FROM s""")
def z07_reply_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'assistant' AND text IS NOT NULL")
    reply = F.concat("text", _pick((" so $y = 2 x$ ?", " Why? And how? x = 3", " The lecture notes say $x = 2$", " see $ 2x $"), F.col("turn") % 4))
    cites = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("P1"), F.concat(F.lit("P"), F.col("turn").cast("string")))).otherwise(F.array().cast("array<string>"))
    known = F.array(*[F.lit(p) for p in ("P1", "P2", "P3")])
    return c.select("conv_id", "turn", F.array_join(dialogue.reply_problems(reply, F.lit("2 x"), cites, known), " ").alias("problems"))


_KINDS = ("presented", "transient", "permanent", "partially_presented", "expired", "superseded", "question", "answered")
#: Events of an action: its order's lines, some reported twice.
_HISTORY = f"h AS (SELECT l_orderkey AS action_id, l_orderkey * 10 + l_linenumber % 4 AS result_id, l_linenumber AS ord, [{quoted(_KINDS)}][(l_orderkey + l_partkey) % 8 + 1] AS kind, l_partkey FROM lineitem), one AS (SELECT * FROM (SELECT action_id, result_id, ord * 1000000 + l_partkey AS ord, kind FROM h) QUALIFY row_number() OVER (PARTITION BY action_id, result_id ORDER BY ord, kind) = 1)"


@query(f"""WITH {_HISTORY}, f AS (SELECT *, kind IN ('presented', 'partially_presented', 'answered') AS shows, row_number() OVER w AS i FROM one WINDOW w AS (PARTITION BY action_id ORDER BY ord, result_id)),
e AS (SELECT action_id, min(i) FILTER (kind <> 'transient') AS i, bool_or(true) AS any_ FROM f GROUP BY 1), d AS (SELECT e.action_id, e.i, f.shows, f.kind FROM e LEFT JOIN f ON f.action_id = e.action_id AND f.i = e.i),
g AS (SELECT d.action_id, d.i, d.shows, d.kind, bool_or(f.shows AND f.i > d.i) AS again, count(*) FILTER (NOT f.shows AND f.i > d.i) AS bad FROM d JOIN f USING (action_id) GROUP BY ALL)
SELECT o_custkey AS session_id, o_orderkey AS action_id, CASE WHEN g.action_id IS NULL THEN 'selected' WHEN i IS NULL THEN 'undelivered' WHEN shows THEN 'presented' WHEN again THEN 'presented_late' ELSE 'discarded' END AS status,
 CASE WHEN i IS NOT NULL AND NOT shows THEN CASE kind WHEN 'permanent' THEN 'permanent_delivery_failure' WHEN 'expired' THEN 'expired' WHEN 'superseded' THEN 'superseded_by_new_evidence' ELSE 'superseded_by_new_question' END END AS reason, CASE WHEN shows THEN bad ELSE 0 END AS conflicts FROM orders LEFT JOIN g ON g.action_id = o_orderkey""")
def z09_z13_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses, single use of result ids, late results, time-outs, and settlement by the next event."""
    actions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("action_id"))
    return dialogue.settled(actions, _results(spark, sf_dir))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(F.col("l_orderkey").alias("action_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber") % 4).alias("result_id"), (F.col("l_linenumber") * F.lit(1000000).cast("bigint") + F.col("l_partkey")).alias("at"), _pick(_KINDS, (F.col("l_orderkey") + F.col("l_partkey")) % 8).alias("kind"))


@query("""WITH RECURSIVE e AS (SELECT o_custkey AS s, o_orderkey AS at, o_orderkey % 3 AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
r AS (SELECT s, at, i, CASE WHEN b = 0 THEN 1 ELSE 0 END::BIGINT AS v, b = 0 AS ok FROM e WHERE i = 1 UNION ALL SELECT e.s, e.at, e.i, r.v + (e.b = r.v)::INT, e.b = r.v FROM r JOIN e ON e.s = r.s AND e.i = r.i + 1)
SELECT s AS session_id, at, v AS version, ok AS applied FROM r""".replace(" at,", " a,").replace(" AS at", " AS a").replace("e.at", "e.a").replace("a, v AS version", "a AS ordinal, v AS version"))
def z14_versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("at"), (F.col("o_orderkey") % 3).alias("based_on"))
    return dialogue.versioned(o).withColumnRenamed("at", "ordinal")


_RESULTS = ("PRESENTED", "PARTIAL", "FAILED", "REJECTED", "CANCELLED", "ACCEPTED", "PRESENTING")


@query(f"""WITH r AS (SELECT event_id, [{quoted(_RESULTS)}][event_id % 7 + 1] AS res, event_id % 2 = 0 AS render, event_id % 3 = 0 AS shown FROM events)
SELECT event_id, CASE WHEN res = 'PRESENTED' THEN 'presented' WHEN res = 'PARTIAL' AND shown THEN 'partially_presented' WHEN res IN ('ACCEPTED', 'PRESENTING') THEN NULL ELSE 'failed' END AS status, CASE WHEN res = 'REJECTED' OR (res = 'FAILED' AND render) THEN 'permanent' WHEN res IN ('FAILED', 'CANCELLED') OR (res = 'PARTIAL' AND NOT shown) THEN 'transient' END AS failure FROM r""")
def z15_delivery_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    s = dialogue.delivery_status(_pick(_RESULTS, k % 7), F.when(k % 2 == 0, "RENDER_FAILED").otherwise("TIMEOUT"), k % 3 == 0)
    return table(spark, sf_dir, "events").select("event_id", s.alias("s")).select("event_id", "s.status", "s.failure")


@query("""WITH RECURSIVE e AS (SELECT user_id AS s, event_id % 3 AS g, event_id, event_type AS k, event_id // 3 % 3 AS p, event_id % 5 = 0 AS a, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) AS i FROM events),
step AS (SELECT *, CASE k WHEN 'click' THEN CASE WHEN a THEN 1 ELSE 2 END WHEN 'view' THEN least(p, CASE WHEN a THEN 1 ELSE 2 END) WHEN 'purchase' THEN 2 ELSE 0 END AS up FROM e),
r AS (SELECT s, g, i, CASE WHEN k = 'error' THEN 0 ELSE up END::BIGINT AS st FROM step WHERE i = 1 UNION ALL SELECT t.s, t.g, t.i, CASE WHEN t.k = 'error' THEN 0 ELSE greatest(r.st, t.up) END::BIGINT FROM r JOIN step t ON t.s = r.s AND t.g = r.g AND t.i = r.i + 1)
SELECT s AS session_id, g AS gap_id, ['open', 'partial', 'closed'][arg_max(st, i) + 1] AS status FROM r GROUP BY ALL""")
def z16_gap_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks solve, views propose, errors contradict, purchases are passed transfers."""
    k = F.col("event_id")
    kind = F.create_map(*[F.lit(x) for x in ("click", "solved", "view", "update", "error", "contradiction", "purchase", "transfer", "signup", "said")])[F.col("event_type")]
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), (k % 3).alias("gap_id"), k.alias("at"), kind.alias("kind"), _pick(("open", "partial", "closed"), F.floor(k / 3) % 3).alias("proposed"), (k % 5 == 0).alias("assisted"))
    return dialogue.gap_changes(e)


@query("""SELECT event_type AS "group", count(*) AS turns, round(avg((event_id % 4 <> 0)::INT), 6) AS agreement, count_if(event_id % 11 = 0)::BIGINT AS leaks, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, count_if(event_id % 9 = 0)::BIGINT AS discards FROM events GROUP BY 1""")
def z18_quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("group"), (k % 4 != 0).cast("int").alias("agreed"), (k % 11 == 0).alias("leaked"), F.col("value").alias("seconds"), F.when(k % 9 == 0, "expired").alias("discard_reason"))
    return dialogue.quality_metrics(e)


@query("""WITH e AS (SELECT (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS id, l_partkey AS p, l_orderkey + (l_partkey % 23 = 0)::INT * 100000000 AS sub FROM lineitem)
SELECT DISTINCT * FROM (SELECT 'unlinked_evidence' AS invariant, id AS record FROM e WHERE sub NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'unconfirmed_meaning', id FROM e WHERE p % 7 = 0 AND p % 2 = 1 AND p % 3 <> 0 UNION ALL SELECT 'learning_label', id FROM e WHERE p % 29 = 0 UNION ALL SELECT 'fabricated_content', id FROM e WHERE p % 10 = 3 AND p % 4 <> 0)""")
def z19_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_partkey")
    # the record's number isn't unique once part keys pass 100,000, so evidence and ambiguities meet by what it is made of
    l = table(spark, sf_dir, "lineitem").withColumn("evidence_id", F.struct("l_orderkey", "l_linenumber", "l_partkey"))  # noqa: E741
    evidence = l.select("evidence_id", (F.col("l_orderkey") + F.when(p % 23 == 0, 100000000).otherwise(0)).alias("submission_id"), F.when(p % 3 == 0, "partial").otherwise("valid").alias("validation_status"), F.when(p % 29 == 0, 0.5).alias("mastery"), F.when(p % 10 == 3, "failed").otherwise("complete").alias("recognition_status"), F.when(p % 4 != 0, "text").alias("content"))
    ambiguities = l.select("evidence_id", (p % 7 == 0).alias("meaning_changed"), (p % 2 == 0).alias("confirmed"))
    found = dialogue.broken_invariants(evidence, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("submission_id")), ambiguities)
    number = (F.col("record.l_orderkey") * 10 + F.col("record.l_linenumber")) * 100000 + F.col("record.l_partkey")
    return found.select("invariant", number.alias("record")).distinct()


@query("""SELECT event_id AS turn_id, CASE WHEN event_id % 11 = 0 THEN 'evidence' WHEN event_id % 7 = 0 THEN 'tutoring_engine' WHEN event_id % 5 = 0 THEN 'delivery' WHEN event_id % 3 = 0 THEN 'delivery_recording' END AS failed_stage, CASE WHEN event_id % 11 = 0 THEN 'not_ready' WHEN event_id % 7 = 0 THEN 'engine_handoff_failed' WHEN event_id % 5 = 0 THEN 'delivery_handoff_failed' WHEN event_id % 3 = 0 THEN 'delivery_result_handoff_failed' END AS error_code,
 CASE WHEN event_id % 11 = 0 THEN 'rejected' WHEN event_id % 7 = 0 THEN 'failure' WHEN event_id % 5 = 0 THEN 'action_selected failure' WHEN event_id % 3 = 0 THEN 'action_selected delivery failure' ELSE 'action_selected delivery delivery_recorded' END AS trace FROM events""")
def u11_handoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return dialogue.handoffs(table(spark, sf_dir, "events").select(k.alias("turn_id"), (k % 11 != 0).alias("valid"), (k % 7 != 0).alias("action_ok"), (k % 5 != 0).alias("delivery_ok"), (k % 3 != 0).alias("recorded_ok")))


@query("""WITH t AS (SELECT a.conv_id, a.turn, a.text AS student, b.text AS tutor FROM conversations a LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' WHERE a.role = 'user'), e AS (SELECT conv_id, turn, 0 AS ix, 'student' AS speaker, student AS said FROM t UNION ALL SELECT conv_id, turn, 1, 'tutor', tutor FROM t)
SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, ix) AS entry, speaker, said FROM e WHERE trim(said) <> ''""")
def u14_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    answers = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tutor"))
    turns = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("student")).join(answers, ["conv_id", "turn"], "left")
    return dialogue.transcript(turns.withColumnRenamed("conv_id", "session_id"))
