"""Evaluation: conditional counts, rollups, threshold sweeps, completeness at k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame) -> DataFrame:
    """Counts of (predicted, actual)."""
    return rows.groupBy("predicted", "actual").agg(F.count(F.lit(1)).alias("n"))


def by_kind(rows: DataFrame, kind: str) -> DataFrame:
    """Accuracy over all and for every kind (null kind: all)."""
    out = rows.groupingSets([[], [F.col(kind)]], F.col(kind)).agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"))
    return out.withColumn("accuracy", F.round(F.col("n_ok") / F.col("n"), 6))


def sweep(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """Counts of decisions for each threshold of a fixed short list; rows are read once and not multiplied before the partial sums."""
    sums = [F.struct(F.lit(t).alias("threshold"), F.count_if((F.col("p") >= t) & F.col("truth")).alias("hits"), F.count_if((F.col("p") >= t) & ~F.col("truth")).alias("false_alarms"), F.count_if((F.col("p") < t) & F.col("truth")).alias("misses")) for t in thresholds]
    return rows.agg(F.array(*sums).alias("s")).select(F.explode("s").alias("x")).select("x.*")


def complete_at(results: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(question_id, complete): every group of anchors has one that the first k results hold."""
    hit = gold.join(results.where(F.col("rank") <= k).select("question_id", F.col("passage_id"), F.lit(True).alias("hit")), ["question_id", "passage_id"], "left")
    groups = hit.groupBy("question_id", "group_id").agg(F.bool_or(F.coalesce("hit", F.lit(False))).alias("found"))
    return groups.groupBy("question_id").agg(F.bool_and("found").alias("complete"), F.count(F.lit(1)).alias("n_groups"))


def usage(calls: DataFrame) -> DataFrame:
    """Calls, cached ones, tokens and cost by provider."""
    return calls.groupBy("provider").agg(F.count(F.lit(1)).alias("calls"), F.count_if("cached").alias("cached"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"), F.round(F.avg("ms"), 3).alias("mean_ms"))
