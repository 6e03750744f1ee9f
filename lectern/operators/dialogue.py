"""The specified engine: intents, verdicts, ladders, phases, replies, and the outbox of actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed


def primary_type(intents: Column) -> Column:
    """The intent that comes first in the order of types; DISTRESS alone is HELP."""
    out = F.lit(None).cast("string")
    for name in reversed(fixed.TURN_ORDER):
        out = F.when(F.array_contains(intents, F.lit(name)), F.lit("HELP" if name == "DISTRESS" else name)).otherwise(out)
    return out


def reconciled(tool: Column, missing_constant: Column, model: Column, confidence: Column) -> Column:
    """(verdict, source) of the math tool's and the model's results; a null model is a failed assessment. The first rule that holds wins."""
    m = F.coalesce(model, F.lit(""))
    unsure = F.lit("UNCLEAR")
    rules = [
        ((tool == "correct") & missing_constant, F.lit("D7"), "tool"), (model.isNull() & (tool == "correct"), F.lit("CORRECT"), "tool"), (model.isNull(), unsure, "none"), (confidence == "low", unsure, "none"),
        ((tool == "correct") & m.isin("CORRECT", "D7"), model, "tool"), (tool == "correct", unsure, "none"), ((tool == "incorrect") & (m == "CORRECT"), unsure, "none"), (tool == "incorrect", model, "tool"),
        ((tool == "absent") & (m == "CORRECT"), unsure, "none"), (tool == "absent", model, "none"), ((m == "CORRECT") & (confidence == "high"), model, "model"), (m == "CORRECT", unsure, "none"),
        (m.isin("D5", "D6") & (confidence != "high"), unsure, "none"),
    ]
    out = F.struct(model.alias("verdict"), F.lit("model").alias("source"))
    for test, verdict, source in reversed(rules):
        out = F.when(F.coalesce(test, F.lit(False)), F.struct(verdict.alias("verdict"), F.lit(source).alias("source"))).otherwise(out)
    return out


def ladder_card(diagnosis: Column, level: Column, last: Column, unavailable: Column) -> Column:
    """The card of a ladder at a help level: unavailable ones and the one shown last are passed over to the right; the end is PARK."""
    row = F.create_map(*[x for k, v in fixed.LADDERS.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])[F.coalesce(diagnosis, F.lit("D0"))]
    start = F.least(level, F.size(row) - 1)
    free = lambda c, i: (i >= start) & ((c == "PARK") | (~F.coalesce(F.array_contains(unavailable, c), F.lit(False)) & ~F.coalesce(c == last, F.lit(False))))
    return F.get(F.filter(row, free), F.lit(0))


def transition(spark, turns: DataFrame) -> DataFrame:
    """turns (phase, event, turn_count, main_solved, active_problem, ...) with the next phase and card; the turn limit ends every unfinished phase."""
    table = spark.createDataFrame(list(fixed.TRANSITIONS), "phase string, event string, next string, card string")
    j = turns.join(F.broadcast(table), ["phase", "event"], "left")  # thirteen rows
    limit = (F.col("turn_count") >= 15) & ~F.col("phase").isin("RESOLVED", "PARKED")
    card = F.when(limit, F.when(F.col("main_solved") & (F.col("active_problem") == 0), "WRAP_UP").otherwise("PARK")).otherwise(F.coalesce("card", F.lit("REDIRECT")))
    return j.withColumn("card", card).withColumn("next", F.when(limit, "PARKED").otherwise(F.coalesce("next", "phase")))


def cards(spark) -> DataFrame:
    return spark.createDataFrame(list(fixed.CARDS), "card string, action string, search string, assists boolean, disclosure string")


def reply_problems(reply: Column, answer: Column, cites: Column, known: Column) -> Column:
    """The ordered checks that code makes of a reply: math outside dollars, the final answer, questions, citations, unsupported claims, length."""
    outside = F.regexp_replace(reply, r"\$[^$]*\$", " ")
    inside = F.regexp_extract_all(reply, F.lit(r"\$([^$]*)\$"), F.lit(1))
    plain = lambda x: F.regexp_replace(F.lower(x), r"\s+", "")
    value = lambda s: F.element_at(F.split(s, "="), -1)
    leaks = F.exists(inside, lambda s: ~s.rlike(r"^\s*[a-zA-Z]\s*=") & (plain(value(s)) == plain(answer)))
    unknown = F.size(F.array_except(cites, known)) > 0
    claims = reply.rlike(r"(?i)\b(lecture|notes|textbook|course materials?)\b") & (F.size(cites) == 0)
    words = F.size(F.filter(F.split(reply, r"\s+"), lambda w: w != ""))
    said = lambda test, name: F.when(F.coalesce(test, F.lit(False)), F.lit(name))
    return F.array_compact(F.array(said(outside.rlike(r"[=^∫√]"), "math_outside"), said(leaks, "final_answer"), said(F.char_length(reply) - F.char_length(F.translate(reply, "?", "")) > 1, "questions"), said(unknown, "citation"), said(claims, "unsupported_claim"), said(words > 120, "length")))


def delivery_status(result: Column, code: Column, text_shown: Column) -> Column:
    """(presentation_status, failure_class) of a delivery result; null for results that aren't final."""
    key = F.when((result == "PARTIAL") & text_shown, "PARTIAL_TEXT").when((result == "FAILED") & (code == "RENDER_FAILED"), "RENDER_FAILED").otherwise(result)
    out = F.lit(None).cast("struct<status:string,failure:string>")
    for name, status, failure in fixed.DELIVERED:
        out = F.when(key == name, F.struct(F.lit(status).alias("status"), F.lit(failure).cast("string").alias("failure"))).otherwise(out)
    return out


def settled(actions: DataFrame, events: DataFrame) -> DataFrame:
    """The status of every action (session_id, action_id, seq) after the events (action_id, result_id, at, kind) about it, as one fold in their order.

    Kinds: presented, partially_presented, transient, permanent, expired, superseded, question, answered (the student's next evidence lists the action).
    A result id counts once. Presented is final; presented after a discard is late; a failure after presentation is a conflict, and changes nothing.
    """
    first = Window.partitionBy("action_id", "result_id").orderBy("at")
    once = events.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    history = once.groupBy("action_id").agg(F.array_sort(F.collect_list(F.struct("at", "result_id", "kind"))).alias("events"))
    start = F.struct(F.lit("selected").alias("status"), F.lit(None).cast("string").alias("reason"), F.lit(0).alias("conflicts"))
    reasons = F.create_map(*[F.lit(x) for x in ("permanent", "permanent_delivery_failure", "expired", "expired", "superseded", "superseded_by_new_evidence", "question", "superseded_by_new_question")])

    def step(s: Column, e: Column) -> Column:
        kind, seen = e["kind"], s["status"] == "presented"
        gone = s["status"].isin("discarded", "presented_late")
        shows = kind.isin("presented", "partially_presented", "answered")
        status = F.when(seen, "presented").when(gone & shows, "presented_late").when(gone, s["status"]).when(shows, "presented").when(kind == "transient", "undelivered").otherwise("discarded")
        reason = F.when(~seen & ~gone & ~shows & (kind != "transient"), reasons[kind]).otherwise(s["reason"])
        return F.struct(status.alias("status"), reason.alias("reason"), (s["conflicts"] + F.when(seen & ~shows, 1).otherwise(0)).alias("conflicts"))

    out = actions.join(history, "action_id", "left")
    return out.withColumn("_s", F.aggregate(F.coalesce("events", F.array().cast("array<struct<at:bigint,result_id:bigint,kind:string>>")), start, step)).select("session_id", "action_id", F.col("_s")["status"].alias("status"), F.col("_s")["reason"].alias("reason"), F.col("_s")["conflicts"].cast("long").alias("conflicts"))


def gap_changes(events: DataFrame) -> DataFrame:
    """The status of each gap (session_id, gap_id, at, kind, proposed, assisted) after its events, as one fold: solving closes, with help only to partial; contradiction reopens; passed transfer closes."""
    history = events.groupBy("session_id", "gap_id").agg(F.array_sort(F.collect_list(F.struct("at", "kind", "proposed", "assisted"))).alias("events"))
    rank = lambda x: F.when(x == "closed", 2).when(x == "partial", 1).otherwise(0)
    name = lambda r: F.element_at(F.array(F.lit("open"), F.lit("partial"), F.lit("closed")), (r + 1).cast("int"))

    def step(s: Column, e: Column) -> Column:
        most = F.when(e["assisted"], 1).otherwise(2)
        solved, update = F.greatest(s, most), F.greatest(s, F.least(rank(e["proposed"]), most))
        return F.when(e["kind"] == "solved", solved).when(e["kind"] == "update", update).when(e["kind"] == "contradiction", F.least(s, F.lit(0))).when(e["kind"] == "transfer", F.lit(2)).otherwise(s).cast("int")

    return history.select("session_id", "gap_id", name(F.aggregate("events", F.lit(0), step)).alias("status"))


def versioned(commits: DataFrame) -> DataFrame:
    """Commits (session_id, at, based_on) taken in order, each only if it was built on the version that is current; a taken one makes the next version."""
    history = commits.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("at", "based_on"))).alias("events"))
    start = F.struct(F.lit(0).cast("bigint").alias("version"), F.array().cast("array<struct<at:bigint,version:bigint,applied:boolean>>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        ok = e["based_on"] == s["version"]
        version = s["version"] + ok.cast("bigint")
        return F.struct(version.alias("version"), F.concat(s["out"], F.array(F.struct(e["at"].alias("at"), version.alias("version"), ok.alias("applied")))).alias("out"))

    return history.select("session_id", F.explode(F.aggregate("events", start, step)["out"]).alias("x")).select("session_id", "x.*")


def handoffs(turns: DataFrame) -> DataFrame:
    """The stage at which a turn (turn_id, valid, action_ok, delivery_ok, recorded_ok) failed, its error code, and the trace of what was done."""
    stages = [("evidence", "not_ready", ~F.col("valid"), "rejected"), ("tutoring_engine", "engine_handoff_failed", ~F.col("action_ok"), "failure"), ("delivery", "delivery_handoff_failed", ~F.col("delivery_ok"), "action_selected failure"), ("delivery_recording", "delivery_result_handoff_failed", ~F.col("recorded_ok"), "action_selected delivery failure")]
    pick = lambda i, end: F.coalesce(*[F.when(s[2], F.lit(s[i])) for s in stages], F.lit(end).cast("string"))
    return turns.select("turn_id", pick(0, None).alias("failed_stage"), pick(1, None).alias("error_code"), pick(3, "action_selected delivery delivery_recorded").alias("trace"))


def transcript(turns: DataFrame) -> DataFrame:
    """The transcript of turns (session_id, turn, student, tutor): two entries a turn, empty ones left out, numbered through the session."""
    said = F.filter(F.array(F.struct(F.lit("student").alias("speaker"), F.col("student").alias("said")), F.struct(F.lit("tutor").alias("speaker"), F.col("tutor").alias("said"))), lambda e: F.coalesce(F.trim(e["said"]) != "", F.lit(False)))
    rows = turns.select("session_id", "turn", F.posexplode(said).alias("at", "e"))
    return rows.select("session_id", F.row_number().over(Window.partitionBy("session_id").orderBy("turn", "at")).cast("long").alias("entry"), "e.*")


def quality_metrics(turns: DataFrame) -> DataFrame:
    """By group of turns (group, agreed, leaked, seconds, discard_reason): agreement, leaks, exact 50th and 95th percentiles of time, discards."""
    part = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY seconds)")
    return turns.groupBy("group").agg(F.count(F.lit(1)).alias("turns"), F.round(F.avg(F.col("agreed").cast("double")), 6).alias("agreement"), F.count_if("leaked").alias("leaks"), part(0.5).alias("p50"), part(0.95).alias("p95"), F.count("discard_reason").alias("discards"))


def broken_invariants(evidence: DataFrame, submissions: DataFrame, ambiguities: DataFrame) -> DataFrame:
    """(invariant, record): evidence of no submission, meaning changed without confirmation, learning labels in evidence, content that came of a failed recognition."""
    linked = evidence.join(submissions.select("submission_id"), "submission_id", "left_anti").select(F.lit("unlinked_evidence").alias("invariant"), F.col("evidence_id").alias("record"))
    silent = ambiguities.where("meaning_changed AND NOT confirmed").join(evidence.where("validation_status = 'valid'"), "evidence_id", "left_semi").select(F.lit("unconfirmed_meaning").alias("invariant"), F.col("evidence_id").alias("record")).distinct()
    labelled = evidence.where("mastery IS NOT NULL").select(F.lit("learning_label").alias("invariant"), F.col("evidence_id").alias("record"))
    invented = evidence.where("recognition_status = 'failed' AND content IS NOT NULL").select(F.lit("fabricated_content").alias("invariant"), F.col("evidence_id").alias("record"))
    return linked.unionByName(silent).unionByName(labelled).unionByName(invented)
