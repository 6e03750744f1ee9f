"""Retrieval plans: menus, drafts, checks of plans and tool arguments, requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text


def _among(x: Column, names: tuple[str, ...]) -> Column:
    return F.coalesce(x.isin(*names), F.lit(False))


def _told(test: Column, what: Column | str) -> Column:
    """A problem, or null."""
    return F.when(F.coalesce(test, F.lit(False)), F.lit(what) if isinstance(what, str) else what)


def concept_menu(turns: DataFrame, catalog: DataFrame, limit: int = fixed.MENU) -> DataFrame:
    """turns (with hits, concept ids best first) and `menu`: the whole catalog (concept_id, ordinal) if it is small, else the hits and then the catalog's first."""
    head = catalog.orderBy("ordinal").limit(limit).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "concept_id"))), lambda x: x["concept_id"]).alias("_head"))
    size = catalog.agg(F.count(F.lit(1)).alias("_n"))
    menu = F.when(F.col("_n") <= limit, F.col("_head")).otherwise(F.slice(F.array_distinct(F.concat("hits", "_head")), 1, limit))
    return turns.crossJoin(F.broadcast(head)).crossJoin(F.broadcast(size)).withColumn("menu", menu).drop("_head", "_n")  # one row each


def drafted(contexts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Plan drafts of contexts (turn_id, schema_ids, linked_ids, intent, prompt, need_types) with catalog (concept_id, name, module_id).

    Known concepts of the question schema are all primary; without one, the linked ones are taken, the first as primary.
    """
    listed = lambda c, source: contexts.select("turn_id", F.lit(source).alias("source"), F.posexplode(c).alias("at", "concept_id"))
    known = listed("schema_ids", "question_schema").unionByName(listed("linked_ids", "linked")).join(catalog, "concept_id")
    entry = F.struct("at", "concept_id", "name", "module_id", "source")
    pick = lambda source: F.array_sort(F.collect_list(F.when(F.col("source") == source, entry)))
    of_turn = known.groupBy("turn_id").agg(pick("question_schema").alias("_schema"), pick("linked").alias("_linked"))
    role = lambda c, r: F.struct(c["concept_id"].alias("concept_id"), c["name"].alias("name"), c["module_id"].alias("module_id"), c["source"].alias("source"), r.alias("role"))
    fixed_ones = F.transform("_schema", lambda c: role(c, F.lit("primary")))
    linked = F.transform("_linked", lambda c, i: role(c, F.when(i == 0, "primary").otherwise("related")))
    none = F.array().cast("array<struct<concept_id:bigint,name:string,module_id:string,source:string,role:string>>")
    d = contexts.join(of_turn, "turn_id", "left").withColumn("concepts", F.when(F.size("_schema") > 0, fixed_ones).when(F.size("_linked") > 0, linked).otherwise(none))
    d = d.withColumn("_primary", F.filter("concepts", lambda c: c["role"] == "primary")).withColumn("_names", F.transform("_primary", lambda c: c["name"]))
    topic, intent = F.array_join("_names", ", "), F.coalesce("intent", F.lit(""))
    main = F.when((topic != "") & (intent != ""), F.concat(topic, F.lit(": "), intent)).when(topic != "", topic).when(intent != "", intent).otherwise(F.coalesce("prompt", F.lit("")))
    said = F.array_join("_names", " and ")
    queries = F.create_map(*[F.lit(x) for kv in fixed.NEED_QUERIES.items() for x in kv])
    alone = F.size("_names") == 1
    need = lambda t, i: F.struct(F.concat(F.lit("n"), (i + 1).cast("string")).alias("need_id"), t.alias("need_type"), F.substring(F.concat(queries[t], said), 1, fixed.MAX_NEED_CHARS).alias("query"), F.when(t.isin("definition", "theorem_statement") & alone, F.element_at("_names", 1)).alias("anchor"), F.get("_primary", F.lit(0))["concept_id"].alias("concept_id"))
    needs = F.when(F.size("_names") > 0, F.transform(F.slice("need_types", 1, fixed.DRAFT_NEEDS), need))
    status = F.when(F.size("_primary") > 0, "found").otherwise("none_found")
    modules = F.array_sort(F.array_distinct(F.transform("concepts", lambda c: c["module_id"])))
    return d.select("turn_id", "concepts", status.alias("concept_status"), F.substring(text.collapsed(main), 1, fixed.MAX_MAIN_CHARS).alias("main_query"), needs.alias("needs"), modules.alias("module_ids"))


_CONCEPTS = "array<struct<concept_id:bigint,source:string,role:string>>"
_REPAIRS = "array<string>"
_NEEDS = "array<struct<need_type:string,query:string,anchor:string,concept_id:bigint>>"


def finalized(proposals: DataFrame, drafts: DataFrame, catalog: DataFrame, outside: int = -1) -> DataFrame:
    """Plans of a model's proposals (turn_id, concept_id, related_ids, query, needs) over their drafts, and the repairs made.

    Question-schema concepts stay primary; unknown ones, more than the limits, empty and repeated needs go, each with a repair. `outside` is the id by which
    the model says that the course doesn't teach it; needs are (need_type, description, anchor, concept_id).
    """
    ids = proposals.select("turn_id", F.explode(F.concat(F.array("concept_id"), F.coalesce("related_ids", F.array().cast("array<bigint>")))).alias("concept_id")).distinct()
    known = ids.join(catalog.select("concept_id"), "concept_id", "left_semi").groupBy("turn_id").agg(F.collect_set("concept_id").alias("_known"))
    p = proposals.join(drafts.select("turn_id", F.transform("concepts", lambda c: F.struct(c["concept_id"].alias("concept_id"), c["source"].alias("source"), c["role"].alias("role"))).alias("_draft"), F.col("main_query").alias("_main"), F.col("needs").alias("_needs")), "turn_id").join(known, "turn_id", "left")
    p = p.withColumn("_known", F.coalesce("_known", F.array().cast("array<bigint>"))).withColumn("_qs", F.filter("_draft", lambda c: c["source"] == "question_schema"))
    concept = lambda cid, role: F.array(F.struct(cid.alias("concept_id"), F.lit("model").alias("source"), role.alias("role"))).cast(_CONCEPTS)
    has = lambda cs, cid: F.exists(cs, lambda c: c["concept_id"] == cid)
    note = lambda *parts: F.array(F.concat_ws(" ", *[F.lit(x) if isinstance(x, str) else x for x in parts])).cast(_REPAIRS)
    no_notes, no_concepts = F.array().cast(_REPAIRS), F.array().cast(_CONCEPTS)
    first, outside_said = F.col("concept_id"), F.coalesce(F.col("concept_id") == outside, F.lit(False))
    chosen, is_known = first.isNotNull() & ~outside_said, F.array_contains("_known", first)
    added = chosen & F.coalesce(is_known, F.lit(False)) & ~has("_qs", first)
    p = p.withColumn("_c1", F.concat("_qs", F.when(added, concept(first, F.when(F.size("_qs") > 0, "related").otherwise("primary"))).otherwise(no_concepts)))
    p = p.withColumn("_r1", F.when(chosen & ~F.coalesce(is_known, F.lit(False)), note("concept_id unknown_concept_dropped")).when(added & (F.size("_qs") > 0), note("concept_id question_schema_kept_primary")).otherwise(no_notes))
    start = F.struct(F.col("_c1").cast(_CONCEPTS).alias("c"), F.col("_r1").alias("r"), F.lit(False).alias("over"))

    def related(s: Column, cid: Column) -> Column:
        unknown = ~F.array_contains(F.col("_known"), cid)
        skipped = s["over"] | (cid == outside)
        full = F.size(F.filter(s["c"], lambda c: c["role"] == "related")) >= fixed.MAX_RELATED
        drop, cut = ~skipped & unknown, ~skipped & ~unknown & ~has(s["c"], cid) & full
        take = ~skipped & ~unknown & ~has(s["c"], cid) & ~full
        return F.struct(F.concat(s["c"], F.when(take, concept(cid, F.lit("related"))).otherwise(no_concepts)).alias("c"), F.concat(s["r"], F.when(drop, note("related_concept_ids unknown_concept_dropped")).when(cut, note("related_concept_ids truncated")).otherwise(no_notes)).alias("r"), (s["over"] | cut).alias("over"))

    p = p.withColumn("_s", F.aggregate(F.coalesce("related_ids", F.array().cast("array<bigint>")), start, related))
    c, r = F.col("_s")["c"], F.col("_s")["r"]
    ignored = outside_said & (F.size("_qs") > 0)
    out_of_course = outside_said & ~ignored
    lacking = ~out_of_course & ~F.exists(c, lambda x: x["role"] == "primary")
    from_draft, promoted = lacking & (F.size("_draft") > 0), lacking & (F.size("_draft") == 0) & (F.size(c) > 0)
    with_draft = F.concat(F.col("_draft").cast(_CONCEPTS), F.filter(c, lambda x: ~F.exists(F.col("_draft"), lambda d: d["concept_id"] == x["concept_id"])))
    first_up = F.transform(c, lambda x, i: F.struct(x["concept_id"].alias("concept_id"), x["source"].alias("source"), F.when(i == 0, "primary").otherwise(x["role"]).alias("role"))).cast(_CONCEPTS)
    p = p.withColumn("_c2", F.when(from_draft, with_draft).when(promoted, first_up).otherwise(c))
    p = p.withColumn("_r2", F.concat(r, F.when(ignored, note("concept_id not_in_course_ignored")).otherwise(no_notes), F.when(from_draft & first.isNotNull(), note("concept_id concepts_from_draft")).when(promoted, note("related_concept_ids first_related_promoted_to_primary")).otherwise(no_notes), F.when(F.size("_c2") > fixed.MAX_CONCEPTS, note("concepts truncated")).otherwise(no_notes)))
    p = p.withColumn("concepts", F.slice("_c2", 1, fixed.MAX_CONCEPTS)).withColumn("_out", out_of_course)
    p = p.withColumn("_primary", F.transform(F.filter("concepts", lambda x: x["role"] == "primary"), lambda x: x["concept_id"]))
    asked = text.collapsed(F.coalesce("query", F.lit("")))
    p = p.withColumn("_asked", asked).withColumn("main_query", F.when(F.char_length("_asked") < 3, F.col("_main")).otherwise(F.substring("_asked", 1, fixed.MAX_MAIN_CHARS)))
    p = p.withColumn("_r3", F.concat("_r2", F.when(F.char_length("_asked") < 3, note("query main_query_from_draft")).when(F.char_length("_asked") > fixed.MAX_MAIN_CHARS, note("query truncated")).otherwise(no_notes)))

    def need(s: Column, x: Column) -> Column:
        words = text.collapsed(F.coalesce(x["description"], F.lit("")))
        cut = F.substring(words, 1, fixed.MAX_NEED_CHARS)
        invalid = ~_among(x["need_type"], fixed.NEED_TYPES)
        empty = ~invalid & (F.char_length(words) < 3)
        twice = ~invalid & ~empty & F.exists(s["n"], lambda y: F.lower(y["query"]) == F.lower(cut))
        ok = ~invalid & ~empty & ~twice
        own = F.exists(F.col("concepts"), lambda y: y["concept_id"] == x["concept_id"])
        cid = F.when(x["concept_id"].isNotNull() & own, x["concept_id"]).when(F.size("_primary") == 1, F.element_at("_primary", 1))
        anchor = F.when(F.trim(F.coalesce(x["anchor"], F.lit(""))) != "", F.substring(F.trim(x["anchor"]), 1, 80))
        new = F.array(F.struct(x["need_type"].alias("need_type"), cut.alias("query"), anchor.alias("anchor"), cid.alias("concept_id"))).cast(_NEEDS)
        at = F.concat(F.lit("evidence_needs["), s["i"].cast("string"), F.lit("]"))
        long = ~invalid & ~empty & (F.char_length(words) > fixed.MAX_NEED_CHARS)
        notes = F.concat(F.when(invalid, note(at, "invalid_need_dropped")).when(empty, note(at, "empty_need_dropped")).otherwise(no_notes), F.when(long, note(at, "truncated")).otherwise(no_notes), F.when(twice, note(at, "duplicate_dropped")).otherwise(no_notes), F.when(ok & x["concept_id"].isNotNull() & ~own, note(at, "not_a_plan_concept_dropped")).otherwise(no_notes))
        return F.struct((s["i"] + 1).alias("i"), F.concat(s["n"], F.when(ok, new).otherwise(F.array().cast(_NEEDS))).alias("n"), F.concat(s["r"], notes).alias("r"))

    state = F.struct(F.lit(0).alias("i"), F.array().cast(_NEEDS).alias("n"), F.col("_r3").alias("r"))
    p = p.withColumn("_f", F.aggregate("needs", state, need))
    drafted_needs = F.transform(F.coalesce("_needs", F.array().cast("array<struct<need_id:string,need_type:string,query:string,anchor:string,concept_id:bigint>>")), lambda n: F.struct(n["need_type"].alias("need_type"), n["query"].alias("query"), n["anchor"].alias("anchor"), n["concept_id"].alias("concept_id")))
    none_left = F.size(F.col("_f")["n"]) == 0
    every = F.when(none_left, drafted_needs.cast(_NEEDS)).otherwise(F.col("_f")["n"])
    repairs = F.concat(F.col("_f")["r"], F.when(none_left, note("evidence_needs needs_from_draft")).otherwise(no_notes), F.when(F.size(every) > fixed.MAX_NEEDS, note("evidence_needs truncated")).otherwise(no_notes))
    status = F.when(F.col("_out"), "not_in_course").when(F.size("_primary") > 0, "found").otherwise("none_found")
    return p.select("turn_id", "concepts", status.alias("concept_status"), "main_query", F.slice(every, 1, fixed.MAX_NEEDS).alias("needs"), repairs.alias("repairs"))


def plan_problems(status: Column, main_query: Column, concepts: Column, needs: Column, origin: Column, narrowing: Column) -> Column:
    """What is wrong with a plan; concepts are (concept_id, source, role), needs (need_id, need_type, query, concept_id)."""
    has_primary = F.exists(concepts, lambda c: c["role"] == "primary")
    whole = lambda xs: F.array_compact(xs)
    of_concept = F.flatten(F.transform(concepts, lambda c: whole(F.array(_told(~_among(c["source"], ("question_schema", "linked", "model")), "concept source"), _told(~_among(c["role"], ("primary", "related")), "concept role")))))
    of_need = F.flatten(F.transform(needs, lambda n, i: whole(F.array(
        _told(n["need_id"] != F.concat(F.lit("n"), (i + 1).cast("string")), "need_id"), _told(~_among(n["need_type"], fixed.NEED_TYPES), "need_type"),
        _told(~F.char_length(n["query"]).between(3, fixed.MAX_NEED_CHARS), "need query length"), _told(n["concept_id"].isNotNull() & ~F.exists(concepts, lambda c: c["concept_id"] == n["concept_id"]), "need concept not in plan"),
    ))))
    stated = _among(status, ("found", "none_found", "not_in_course"))
    first = whole(F.array(_told(~F.char_length(main_query).between(3, fixed.MAX_MAIN_CHARS), "main_query length"), _told(F.size(concepts) > fixed.MAX_CONCEPTS, "too many concepts")))
    middle = whole(F.array(_told(~stated, "concept_status"), _told(stated & ((status == "found") != has_primary), "concept_status does not match the primary concepts"), _told(~F.size(needs).between(1, fixed.MAX_NEEDS), "needs count")))
    last = whole(F.array(_told(~_among(origin, ("draft", "model")), "origin"), _told(~_among(narrowing, ("not_enforced", "module", "section")), "scope.narrowing")))
    return F.concat(first, of_concept, middle, of_need, last)


def argument_errors(fields: Column, query: Column, purpose: Column, needs: Column) -> Column:
    """Errors of a tool call's arguments: field names, query, purpose and needs (need_type, description)."""
    unknown = F.transform(F.filter(fields, lambda f: ~_among(f, fixed.TOOL_FIELDS)), lambda f: F.concat(f, F.lit(" unknown_field")))
    one = F.array_compact(F.array(_told(~F.coalesce(F.char_length(F.trim(query)).between(3, 300), F.lit(False)), "query invalid"), _told(~_among(purpose, fixed.MODEL_PURPOSES), "purpose invalid_enum"), _told(~F.coalesce(F.size(needs).between(1, 4), F.lit(False)), "evidence_needs invalid")))
    at = lambda i, what: F.concat(F.lit("evidence_needs["), i.cast("string"), F.lit(what))
    each = F.array_compact(F.transform(needs, lambda n, i: F.when(~_among(n["need_type"], fixed.NEED_TYPES), at(i, "].need_type invalid_enum")).when(F.trim(F.coalesce(n["description"], F.lit(""))) == "", at(i, "].description missing"))))
    return F.concat(unknown, one, F.when(F.coalesce(F.size(needs).between(1, 4), F.lit(False)), each).otherwise(F.array().cast("array<string>")))


def request(args: DataFrame) -> DataFrame:
    """Requests of tool calls (turn_id, question_id, siblings, query, purpose, needs, says_student_words, message): origin of the query, bounded fields, questions to leave out."""
    copied = text.copies_text(F.col("query"), F.col("message"))
    origin = F.when(F.coalesce("says_student_words", F.lit(False)) | copied, "student_text").otherwise("structured")
    exclude = F.when(_among(F.col("purpose"), fixed.LEAK_PURPOSES), F.concat(F.array("question_id"), F.coalesce("siblings", F.array().cast("array<bigint>"))))
    needs = F.transform("needs", lambda n, i: F.concat(F.lit("n"), (i + 1).cast("string"), F.lit(" "), n))
    return args.select("turn_id", text.collapsed(F.col("query")).alias("query"), origin.alias("query_origin"), "purpose", needs.alias("needs"), F.substring("message", 1, 2000).alias("scope_check_text"), exclude.alias("exclude"))


def prefetch_query(concepts: Column, intent: Column) -> Column:
    """The query made of structured context alone."""
    names = F.array_join(concepts, ", ")
    topic = F.coalesce(F.when(intent != "", intent), names)
    concept = F.when(names != "", names).otherwise(topic)
    return F.substring(F.when(F.lower(F.trim(topic)) == F.lower(F.trim(concept)), concept).otherwise(F.concat(concept, F.lit(": "), topic)), 1, 300)


def allowed_purposes(purposes: Column) -> Column:
    """The purposes that a turn's tool offers: the policy's that a model may use, or all of these."""
    own = F.filter(purposes, lambda p: _among(p, fixed.MODEL_PURPOSES))
    return F.when(F.size(own) > 0, own).otherwise(F.array(*[F.lit(p) for p in fixed.MODEL_PURPOSES]))


def without_questions(results: DataFrame, requests: DataFrame) -> DataFrame:
    """Results (request_id, question_id, ...) less those of questions that their request leaves out (request_id, exclude)."""
    out = requests.select("request_id", F.explode("exclude").alias("question_id"))
    return results.join(out, ["request_id", "question_id"], "left_anti")


def preferring(results: DataFrame, needs: DataFrame, bonus: float = 0.1) -> DataFrame:
    """Results (need_id, passage_id, block_type, score) ranked with a bonus for block types that the need (need_id, need_type) prefers; a rank bonus, no filter."""
    blocks = F.create_map(*[x for k, v in fixed.PREFERRED_BLOCKS.items() for x in (F.lit(k), F.array(*[F.lit(b) for b in v]).cast("array<string>"))])
    r = results.join(needs, "need_id").withColumn("preferred", F.array_contains(blocks[F.col("need_type")], F.col("block_type")))
    r = r.withColumn("score", F.col("score") + F.when(F.col("preferred"), bonus).otherwise(0.0))
    return r.withColumn("rank", _rank("need_id"))


def _rank(key: str) -> Column:
    from pyspark.sql.window import Window

    return F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "passage_id"))
