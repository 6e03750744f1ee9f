"""Checks of records: course context, sections and blocks, conditions between fields, links between submission and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed, text


def _literal(names: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(n) for n in names]).cast("array<string>")


def _said(test: Column, what: str) -> Column:
    return F.when(F.coalesce(test, F.lit(False)), F.lit(what))


def _lacks(xs: Column, x: Column) -> Column:
    return ~F.coalesce(F.array_contains(xs, x), F.lit(False))


def top_level_errors(keys: Column, version: Column) -> Column:
    """Missing and unexpected keys of a course context, and a version other than 1.x."""
    missing = F.transform(F.filter(_literal(fixed.TOP_KEYS), lambda k: _lacks(keys, k)), lambda k: F.concat(F.lit("missing "), k))
    extra = F.transform(F.array_sort(F.filter(keys, lambda k: ~k.isin(*fixed.TOP_KEYS, *fixed.TOP_OPTIONAL))), lambda k: F.concat(F.lit("unexpected "), k))
    wrong = F.array_compact(F.array(_said((F.trim(version) != "") & ~F.trim(version).rlike(r"^1\.\d+$"), "version")))
    return F.concat(missing, extra, wrong)


def field_errors(kind: Column, fields: Column, is_11: Column) -> Column:
    """V-02 and V-08 of a record (field -> value as JSON text): missing, unknown and empty fields, provenance in a version without it."""
    needed = F.create_map(*[x for k, v in fixed.RECORD_FIELDS.items() for x in (F.lit(k), _literal(v))])[kind]
    holds = F.create_map(*[F.lit(x) for kv in fixed.MUST_HOLD.items() for x in kv])[kind]
    held = F.struct(needed.alias("needed"), holds.alias("holds"), fields.alias("fields"), is_11.alias("is_11"))
    return text.let(held, lambda r: text.let(F.map_keys(r["fields"]), lambda names: _field_errors(r["needed"], r["holds"], r["fields"], names, r["is_11"])))


def _field_errors(needed: Column, holds: Column, fields: Column, names: Column, is_11: Column) -> Column:
    missing = F.transform(F.filter(needed, lambda f: _lacks(names, f)), lambda f: F.concat(F.lit("V-02 missing "), f))
    unknown = F.transform(F.array_sort(F.filter(names, lambda f: _lacks(needed, f) & (f != "provenance"))), lambda f: F.concat(F.lit("V-02 unknown "), f))
    early = F.array_compact(F.array(_said(F.array_contains(names, F.lit("provenance")) & ~is_11, "V-02 provenance before 1.1")))
    there = F.filter(needed, lambda f: F.array_contains(names, f) & ~f.isin(*fixed.MAY_BE_EMPTY))
    bare = lambda f: F.coalesce(F.trim(fields[f]).isin("", "TBD"), F.lit(True))
    empty = F.filter(there, lambda f: F.when(F.coalesce(f == holds, F.lit(False)), F.coalesce(fields[f], F.lit("[]")).isin("[]", "")).otherwise(bare(f)))
    return F.concat(missing, unknown, early, F.transform(empty, lambda f: F.concat(F.lit("V-08 "), f)))


def enum_errors(kind: Column, value: Column, notes: Column) -> Column:
    """V-03: Bloom levels, source types, and notes that don't consist of misconception and mitigation."""
    level = _said((kind == "LearningObjective") & ~F.coalesce(value.isin(*fixed.BLOOM), F.lit(False)), "bloom_level")
    source = _said((kind == "Source") & ~F.coalesce(value.isin(*fixed.SOURCE_TYPES), F.lit(False)), "Source.type")
    odd = F.filter(F.coalesce(notes, F.array().cast("array<array<string>>")), lambda n: F.array_sort(n) != F.array_sort(_literal(fixed.NOTE_KEYS)))
    return F.concat(F.array_compact(F.array(level, source)), F.when(kind == "Concept", F.transform(odd, lambda n: F.lit("difficulty_notes"))).otherwise(F.array().cast("array<string>")))


def provenance_error(is_11: Column, has: Column, value: Column) -> Column:
    """V-10: provenance missing, or none of the known ones."""
    return F.when(is_11 & ~has, "missing").when(is_11 & ~F.coalesce(value.isin(*fixed.PROVENANCE), F.lit(False)), "unknown")


def record_conditions(status: Column, pages: Column, blocks: Column, warnings: Column) -> Column:
    """Conditions between an ingested record's status and the sizes of its lists."""
    failed = status == "failed"
    return F.array_compact(F.array(
        _said(failed & (blocks > 0), "failed with blocks"), _said(failed & (warnings < 1), "failed without a warning"), _said(~failed & (pages < 1), "no pages"),
        _said(~failed & (blocks < 1), "no blocks"), _said((status == "partial") & (warnings < 1), "partial without a warning"),
    ))


def block_conditions(kind: Column, for_block: Column, visibility: Column, concept_source: Column, concepts: Column) -> Column:
    none = concept_source == "none"
    return F.array_compact(F.array(
        _said((kind == "solution") & for_block.isNull(), "solution for no block"), _said((kind == "solution") & (visibility != "engine_only"), "solution is visible"),
        _said((kind == "proof") & for_block.isNull(), "proof of no block"), _said(none & (concepts > 0), "concepts without a source"), _said(~none & (concepts < 1), "no concepts"),
    ))


def bundle_conditions(retrieval: Column, status: Column, passages: Column, uncovered: Column) -> Column:
    return F.array_compact(F.array(
        _said(retrieval.isin("supported", "partial") & (passages < 1), "no passages"), _said((retrieval == "partial") & (F.coalesce(uncovered, F.lit(0)) < 1), "partial, nothing uncovered"),
        _said(retrieval.isin("no_support_found", "failed") & (passages > 0), "passages without support"), _said((retrieval == "failed") & (status != "failed"), "failed, but not said"),
    ))


def dangling(refs: DataFrame, records: DataFrame) -> DataFrame:
    """References (owner, link, kind, target) to no record (kind, id) of their kind: every type of link in one anti-join."""
    there = records.select("kind", F.col("id").alias("target"))
    return refs.join(there, ["kind", "target"], "left_anti").select("owner", "link", "kind", "target")


def section_errors(sections: DataFrame) -> DataFrame:
    """Errors of sections (section_id, parent_id, level, start, end) against their parents."""
    up = sections.select(F.col("section_id").alias("parent_id"), F.col("level").alias("up_level"), F.col("start").alias("up_start"), F.col("end").alias("up_end"), F.lit(True).alias("there"))
    j = sections.join(up, "parent_id", "left")
    top, there = F.col("parent_id").isNull(), F.coalesce("there", F.lit(False))
    errors = F.array_compact(F.array(
        _said(top & (F.col("level") != 1), "top-level section must have level 1"), _said(~top & ~there, "parent not found"), _said(there & (F.col("level") != F.col("up_level") + 1), "level must be parent level + 1"),
        _said(there & ~((F.col("up_start") <= F.col("start")) & (F.col("end") <= F.col("up_end"))), "lies outside its parent"),
    ))
    return j.select("section_id", F.explode(errors).alias("error"))


def membership_errors(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """Blocks (block_id, section_id, start, end) of no section, or outside of it."""
    s = sections.select("section_id", F.col("start").alias("s_start"), F.col("end").alias("s_end"), F.lit(True).alias("there"))
    j = blocks.join(s, "section_id", "left")
    outside = ~((F.col("s_start") <= F.col("start")) & (F.col("end") <= F.col("s_end")))
    return j.withColumn("error", F.when(F.col("there").isNull(), "section not found").when(outside, "lies outside its section")).where("error IS NOT NULL").select("block_id", "section_id", "error")


def link_errors(submissions: DataFrame, evidence: DataFrame, key: str = "record") -> DataFrame:
    """Fields in which evidence differs from its submission, and what a typed submission's evidence may not have."""
    s = submissions.select(key, *[F.col(f).alias(f"_{f}") for f in fixed.LINKED_FIELDS], F.col("submitted_text").alias("_text"))
    j = evidence.join(s, key)
    differ = [_said(~F.col(f).eqNullSafe(F.col(f"_{f}")), f) for f in fixed.LINKED_FIELDS]
    more = [_said(~F.col("confirmed_content").eqNullSafe(F.col("_text")), "confirmed_content"), _said(F.col("recognition_ref").isNotNull() | (F.col("corrections") > 0), "recognition_ref"), _said((F.col("validation_status") != "valid") | (F.col("ambiguities") > 0), "validation_status")]
    return j.select(key, F.array_compact(F.array(*differ, *more)).alias("errors"))


def corrections(reviews: DataFrame) -> DataFrame:
    """A row for each resolved ambiguity of reviews (recognition_id, recognized, confirmed, ambiguities: id, raw_value, resolution), and one for the whole text if it changed or nothing else did."""
    solved = F.filter("ambiguities", lambda a: a["resolution"].isNotNull())
    one = F.transform(solved, lambda a: F.struct(a["id"].alias("location"), a["raw_value"].alias("raw_value"), a["resolution"].alias("corrected_value"), F.lit("ambiguity").alias("reason")))
    whole = F.array(F.struct(F.lit("full_transcription").alias("location"), F.col("recognized").alias("raw_value"), F.col("confirmed").alias("corrected_value"), F.lit("transcription").alias("reason")))
    every = F.when((F.col("confirmed") != F.col("recognized")) | (F.size(solved) == 0), F.concat(one, whole)).otherwise(one)
    return reviews.select("recognition_id", F.posexplode(every).alias("ordinal", "c")).select("recognition_id", F.col("ordinal").cast("long").alias("ordinal"), "c.*")


def correction_metrics(submissions: DataFrame) -> DataFrame:
    """By modality and provider, by modality, and in all: submissions (modality, provider, needs_confirmation, corrections, meaning_changed, failed), shares and means."""
    share = lambda c: F.round(F.avg(F.col(c).cast("double")), 6).alias(c)
    out = submissions.groupingSets([["modality", "provider"], ["modality"], []], "modality", "provider").agg(F.count(F.lit(1)).alias("n"), share("needs_confirmation"), F.round(F.avg(F.col("corrections").cast("double")), 6).alias("corrections"), share("meaning_changed"), share("failed"))
    return out.withColumn("modality", F.coalesce("modality", F.lit("all"))).withColumn("provider", F.coalesce("provider", F.lit("all")))


def module_order_errors(modules: DataFrame, concepts: DataFrame) -> DataFrame:
    """Modules (module_id, listed: place in the course's list, number: in the id) whose number doesn't follow the list, with the count of their concepts."""
    n = concepts.groupBy("module_id").agg(F.count(F.lit(1)).alias("concepts"))
    return modules.where(F.col("number") != F.col("listed")).join(n, "module_id", "left").select("module_id", "listed", "number", F.coalesce("concepts", F.lit(0)).cast("long").alias("concepts"))


def course_name(body: Column, number: Column) -> Column:
    """The first line with the number, without it; if little is left, the next line; else the first line."""
    ls = F.filter(F.transform(F.split(body, r"\r\n|[\r\n]"), lambda x: F.trim(x)), lambda x: x != "")
    hit = F.array_position(F.transform(ls, lambda x: F.contains(F.lower(x), F.lower(number))), F.lit(True)).cast("int")
    left = _less(F.get(ls, hit - 1), number)
    found = F.when(F.coalesce(hit > 0, F.lit(False)) & (F.char_length(left) >= 4), left).when(F.coalesce(hit > 0, F.lit(False)) & (hit < F.size(ls)), F.get(ls, hit))
    return F.substring(F.coalesce(found, F.get(ls, F.lit(0))), 1, 160)


def _less(line: Column, number: Column) -> Column:
    return F.btrim(F.regexp_replace(line, F.concat(F.lit("(?i)\\Q"), number, F.lit("\\E")), F.lit("")), F.lit(" :-–—"))


def explicit_title(body: Column, number: Column) -> Column:
    """The title in the first twenty lines: a line with the number, without it, or a short line that says course, lecture notes or class, without these words."""
    ls = F.filter(F.transform(F.slice(F.split(body, r"\r\n|[\r\n]"), 1, 20), lambda x: F.trim(x)), lambda x: x != "")

    def title(x: Column) -> Column:
        opens = F.lower(x).startswith(fixed.TITLE_OPENINGS[0]) | F.lower(x).startswith(fixed.TITLE_OPENINGS[1]) | F.lower(x).startswith(fixed.TITLE_OPENINGS[2])
        numbered = F.coalesce(F.contains(F.lower(x), F.lower(number)), F.lit(False))
        named = (F.char_length(x) <= 120) & x.rlike(r"(?i)\b(course|lecture notes|class)\b")
        bare = F.btrim(F.regexp_replace(F.regexp_replace(x, r"(?i)\b(course|lecture notes|class|syllabus)\b", " "), r"\s+", " "), F.lit(" :-–—"))
        return F.when(~opens, F.when(numbered & (F.char_length(_less(x, number)) >= 4), _less(x, number)).when(named & (F.char_length(bare) >= 4), bare))

    return F.substring(F.get(F.filter(F.transform(ls, title), lambda x: x.isNotNull()), F.lit(0)), 1, 160)
