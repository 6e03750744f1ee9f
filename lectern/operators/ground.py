"""Grounding: evidence needs against passages, coverage, bundle status, warnings, citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed, text

LEVELS = {"not_covered": 0, "partially_covered": 1, "covered": 2}


def rank_of(level: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), level)


def level_of(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LEVELS]), rank + 1)


def share(wanted: Column, present: Column) -> Column:
    """Share of the distinct wanted terms that are present; 0 without any."""
    n = F.size(F.array_distinct(wanted))
    return F.when(n > 0, F.size(F.array_intersect(wanted, present)) / n).otherwise(F.lit(0.0))


def mentions(name: Column, passage_terms: Column) -> Column:
    return share(text.content_terms(name), passage_terms) >= fixed.MENTION_SHARE


def target_terms(anchor: Column, description: Column, concepts: Column) -> Column:
    """Up to six distinct content terms of the anchor or the description, else of the concepts' names."""
    own = text.content_terms(F.coalesce(F.nullif(anchor, F.lit("")), description))
    return F.slice(F.when(F.size(own) > 0, own).otherwise(text.content_terms(F.array_join(concepts, " "))), 1, 6)


def rule_level(need_type: Column, anchor: Column, description: Column, concepts: Column, body: Column) -> Column:
    """covered, partially_covered or not_covered: gates in order, then the need type's marker."""
    anchor = F.nullif(anchor, F.lit(""))
    words = text.evidence_terms(body)
    concept_ok = (F.size(concepts) == 0) | F.exists(concepts, lambda c: mentions(c, words))
    literal = F.contains(F.lower(body), F.lower(anchor))
    formula = text.is_formula(anchor)
    by_formula = formula & F.contains(text.plain_math(body), text.plain_math(anchor))
    anchor_ok = F.when(anchor.isNull(), share(target_terms(anchor, description, concepts), words) >= fixed.MENTION_SHARE).otherwise(literal | by_formula | (~formula & mentions(anchor, words)))
    marked = reduce(lambda c, kv: c.when(need_type == kv[0], body.rlike(kv[1])), fixed.MARKERS.items(), F.when(F.lit(False), F.lit(False))).otherwise(F.lit(False))
    level = F.when(need_type == "formula_statement", F.when(anchor.isNotNull() & by_formula, "covered").otherwise("partially_covered"))
    level = level.when(need_type == "notation_convention", F.when(anchor.isNotNull() & marked, "covered").otherwise("partially_covered"))
    level = level.when(need_type.isin("definition", "theorem_statement", "worked_example", "exercise"), F.when(marked, "covered").otherwise("partially_covered")).otherwise("partially_covered")
    return F.when(F.coalesce(concept_ok, F.lit(False)) & F.coalesce(anchor_ok, F.lit(False)), level).otherwise("not_covered")


def related(anchor: Column, description: Column, concepts: Column, body: Column) -> Column:
    """The loose gate: the anchor as it stands, or a small share of the target terms."""
    anchor = F.nullif(anchor, F.lit(""))
    words = text.evidence_terms(body)
    return F.coalesce(F.contains(F.lower(body), F.lower(anchor)), F.lit(False)) | (share(target_terms(anchor, description, concepts), words) >= fixed.RELATED_SHARE)


def judge_level(p: Column) -> Column:
    return F.when(p >= fixed.JUDGE_COVERED, "covered").when(p >= fixed.JUDGE_PARTIAL, "partially_covered").otherwise("not_covered")


def merged(rule: Column, probability: Column, mode: Column, pinned: Column) -> Column:
    """A pinned level wins; the judge decides in mode `on` where it answered; else the rules."""
    return F.coalesce(pinned, F.when((mode == "on") & probability.isNotNull(), judge_level(probability)), rule)


def coverage(checks: DataFrame) -> DataFrame:
    """(request_id, need_id, level, passage_ids, detail) of (request_id, need_id, rank, passage_id, level): the best level and all passages at it."""
    best = checks.groupBy("request_id", "need_id").agg(F.max(rank_of(F.col("level"))).alias("best"))
    at = checks.join(best, ["request_id", "need_id"]).where((rank_of(F.col("level")) == F.col("best")) & (F.col("best") > 0))
    ids = at.groupBy("request_id", "need_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "passage_id"))), lambda x: x["passage_id"]).alias("passage_ids"))
    return best.join(ids, ["request_id", "need_id"], "left").select("request_id", "need_id", level_of(F.col("best")).alias("level"), F.coalesce("passage_ids", F.array().cast("array<bigint>")).alias("passage_ids"))


def statuses(cover: DataFrame, gates: DataFrame) -> DataFrame:
    """(request_id, status) from need levels and (request_id, any_related)."""
    by = cover.groupBy("request_id").agg(F.bool_and(F.col("level") == "covered").alias("full"), F.bool_or(F.col("level") != "not_covered").alias("some"))
    status = F.when(~F.coalesce("any_related", F.lit(False)), "no_support_found").when(F.col("full"), "supported").when(F.col("some"), "partial").otherwise("no_support_found")
    return by.join(gates, "request_id", "left").select("request_id", status.alias("status"))


def warnings(provenance: Column, page: Column, issues: Column, level: Column, semantic: Column, skipped: Column) -> Column:
    """Codes that hold for a passage and its bundle."""
    return F.array_compact(F.array(
        F.when(provenance == "ai_generated", F.lit("unverified_source")),
        F.when(page.isNull(), F.lit("location_unavailable")),
        F.when(issues > 0, F.lit("source_quality_warning")),
        F.when(level == "partially_covered", F.lit("sufficiency_uncertain")),
        F.when(~semantic, F.lit("semantic_channel_unavailable")),
        F.when(skipped > 0, F.lit("budget_truncated")),
    ))


def request_errors(course: Column, purpose: Column, query: Column, top_k: Column, needs: Column, known_course: Column) -> Column:
    """Codes of what is wrong with a request, in the order of the checks."""
    return F.array_compact(F.array(
        F.when(F.coalesce(F.trim(query), F.lit("")) == "", F.lit("missing_query")),
        F.when(course.isNull(), F.lit("missing_course")),
        F.when(~F.coalesce(known_course, F.lit(False)), F.lit("unknown_course")),
        F.when(~F.coalesce(purpose.isin(list(fixed.PURPOSES)), F.lit(False)), F.lit("unknown_purpose")),
        F.when(F.length(query) > 2000, F.lit("query_too_long")),
        F.when(~F.coalesce(top_k.between(1, 10), F.lit(False)), F.lit("top_k_out_of_range")),
        F.when(~F.coalesce(needs.between(1, 4), F.lit(False)), F.lit("need_count_out_of_range")),
    ))


def preflight(errors: Column, published: Column, snapshot: Column, policy_snapshot: Column, eligible: Column, reference_only: Column, query: Column, scope: Column) -> Column:
    """The first condition that stops a request before any search, or null."""
    return (
        F.when(F.size(errors) > 0, "invalid_request")
        .when(~published, "course_not_ready")
        .when(snapshot.isNotNull() & (snapshot != policy_snapshot), "version_mismatch")
        .when(eligible == 0, "no_eligible_sources")
        .when(eligible == reference_only, "reference_only")
        .when(text.has_cjk(query), "query_language_unsupported")
        .when(scope == "needs_clarification", "needs_clarification")
        .when(scope == "not_found", "excluded_scope")
    )


def scope_decision(message: Column) -> Column:
    return F.coalesce(*[F.when(message.rlike(p), F.lit(d)) for p, d, _, _ in fixed.SCOPE_RULES], F.lit("retrieve"))


def stricter(a: Column, b: Column) -> Column:
    """Of two scope decisions the stricter one."""
    order = F.create_map(F.lit("retrieve"), F.lit(0), F.lit("needs_clarification"), F.lit(1), F.lit("not_found"), F.lit(2))
    return F.when(F.element_at(order, b) > F.element_at(order, a), b).otherwise(a)


def violations(bundles: DataFrame, passages: DataFrame, cover: DataFrame) -> DataFrame:
    """(request_id, problem): broken invariants of bundles; none is the expected result."""
    ranks = passages.groupBy("request_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("m"), F.countDistinct("rank").alias("d"), F.countDistinct("passage_id").alias("p"))
    gaps = ranks.where("n <> m OR n <> d").select("request_id", F.lit("ranks have gaps").alias("problem"))
    twice = ranks.where("n <> p").select("request_id", F.lit("a passage stands twice").alias("problem"))
    full = cover.groupBy("request_id").agg(F.bool_and(F.col("level") == "covered").alias("full"))
    wrong = bundles.where("status = 'supported'").join(full, "request_id").where(~F.col("full")).select("request_id", F.lit("supported with an open need").alias("problem"))
    cited = cover.select("request_id", F.explode("passage_ids").alias("passage_id")).join(passages.select("request_id", "passage_id"), ["request_id", "passage_id"], "left_anti").select("request_id", F.lit("coverage by an unknown passage").alias("problem")).distinct()
    return gaps.unionByName(twice).unionByName(wrong).unionByName(cited)


def citations(labels: DataFrame, owners: DataFrame) -> DataFrame:
    """Verdict on each cited passage from the first bundle of the same turn that holds it."""
    first = owners.groupBy("turn_id", "passage_id").agg(F.min_by(F.struct("status", "level"), "ordinal").alias("o"))
    good = F.col("o.status").isin("supported", "partial")
    verdict = F.when(~F.coalesce(good, F.lit(False)), "citation_not_from_turn_bundle").when(F.col("o.level") == "covered", "accepted").when(F.col("o.level") == "partially_covered", "accepted_with_warning").otherwise("citation_need_not_covered")
    return labels.join(first, ["turn_id", "passage_id"], "left").select("turn_id", "passage_id", verdict.alias("verdict"))


def labelled(passages: DataFrame) -> DataFrame:
    """P1, P2, ... in the order of first appearance within a turn."""
    first = passages.groupBy("turn_id", "passage_id").agg(F.min("ordinal").alias("ordinal"))
    return first.select("turn_id", "passage_id", F.concat(F.lit("P"), F.row_number().over(Window.partitionBy("turn_id").orderBy("ordinal", "passage_id")).cast("string")).alias("label"))
