"""Grounding bundles: eligible documents, kept results, passages as the model and the public see them, the registry of a turn's bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text


def eligible(documents: DataFrame) -> DataFrame:
    """Documents (allow, review_status): where a course's policy allows no unverified sources, those that are unverified go."""
    return documents.where(~F.coalesce((F.col("allow") == "none") & (F.col("review_status") == "unverified"), F.lit(False)))


def located(results: DataFrame, reference_only: list[str]) -> DataFrame:
    """Results (request_id, rank, source_type) without sources that are for reference only, ranks counted anew."""
    kept = results.where(~F.coalesce(F.col("source_type").isin(reference_only), F.lit(False)))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("request_id").orderBy("rank")).cast("long"))


def distinct_in_order(values: Column) -> Column:
    """The first of equal values, in order; nulls go."""
    return F.array_distinct(F.array_compact(values))


def model_view(passages: DataFrame, coverage: DataFrame) -> DataFrame:
    """Passages (bundle_id, passage_id, rank) with label, citable and the needs that they support, from coverage (bundle_id, ordinal, need_id, coverage, passage_ids)."""
    ok = coverage.where("coverage <> 'not_covered'").select("bundle_id", "ordinal", F.concat(F.col("need_id"), F.lit(" ("), F.col("coverage"), F.lit(")")).alias("said"), F.explode(F.array_distinct("passage_ids")).alias("passage_id"))
    supports = ok.groupBy("bundle_id", "passage_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "said"))), lambda x: x["said"]).alias("supports"))
    j = passages.join(supports, ["bundle_id", "passage_id"], "left").withColumn("supports", F.coalesce("supports", F.array().cast("array<string>")))
    label = F.concat(F.lit("P"), F.row_number().over(Window.partitionBy("bundle_id").orderBy("rank")).cast("string"))
    return j.select("bundle_id", "passage_id", label.alias("label"), (F.size("supports") > 0).alias("citable"), "supports")


def public_record(rows: DataFrame, labels: dict[str, str], other: str) -> DataFrame:
    """Passages (document_id, sha256, start, end, body, source_type, section_path, rank) as public records: identity, version, label."""
    version = F.concat(F.lit("cv-src-"), F.substring("sha256", 1, 12))
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])[F.col("source_type")], F.lit(other))
    label = F.concat(named, F.when(F.coalesce("section_path", F.lit("")) != "", F.concat(F.lit(", "), F.col("section_path"))).otherwise(""))
    identity = text.passage_id(F.col("document_id"), version, F.lit(None), F.col("start"), F.col("end"))
    return rows.select(identity.alias("passage_id"), "document_id", version.alias("content_version"), F.trim("body").alias("passage_text"), F.col("rank").alias("retrieval_rank"), label.alias("source_label"))


def registered(bundles: DataFrame) -> DataFrame:
    """The bundles of every (session_id, turn_id), the last one of an id, in the order of their first issue; bundles are (issued, bundle_id, session_id, turn_id)."""
    last = bundles.groupBy("bundle_id").agg(F.max_by(F.struct("session_id", "turn_id"), "issued").alias("l"), F.min("issued").alias("first"))
    return last.groupBy("l.session_id", "l.turn_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "bundle_id"))), lambda x: x["bundle_id"]).alias("bundles"))


def resolved(passages: DataFrame) -> DataFrame:
    """(passage_id, bundle_id) of passages (issued, bundle_id, passage_id): the bundle that issued each first."""
    return passages.groupBy("passage_id").agg(F.min_by("bundle_id", F.struct("issued", "bundle_id")).alias("bundle_id"))
