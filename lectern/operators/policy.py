"""Planning: grounding policy, concept linking, plan drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fixed, text


def policy_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fixed.GROUNDING_POLICY), "action string, mode string, purposes array<string>, need_types array<string>, exclude_current boolean, engine_only boolean")


def recommended(actions: DataFrame, table: DataFrame) -> DataFrame:
    """mode and need types of (action, states_content, checks_convention, ready): the table's row with its three exceptions."""
    r = actions.join(F.broadcast(table), "action")  # twelve rows
    convention = (F.col("action") == "verify") & F.coalesce("checks_convention", F.lit(False))
    mode = F.when((F.col("action") == "hint") & (F.col("states_content") == F.lit(False)), "may").when(convention, "may").otherwise(F.col("mode"))
    needs = F.when(convention, F.array(F.lit("notation_convention"))).otherwise(F.col("need_types"))
    return r.withColumn("_m", mode).withColumn("need_types", needs).withColumn("mode", F.when(~F.col("ready") & F.col("_m").isin("must", "may"), "not_needed").otherwise(F.col("_m"))).drop("_m")


def forced(mode: Column, p: Column) -> Column:
    """A recommender may turn `may` into must or not_needed."""
    return F.when((mode == "may") & (p >= fixed.FORCE), "must").when((mode == "may") & (p < fixed.SKIP), "not_needed").otherwise(mode)


def linked(texts: DataFrame, phrases: DataFrame, k: int = 8) -> DataFrame:
    """Concepts named by each text: (text_id, concept_id, rank, score, full, selected).

    phrases is (concept_id, phrase_no, phrase). A phrase counts if half of its terms occur; the score is the sum of their
    idf, half as much again if all occur. Terms meet in a hash join.
    """
    p = phrases.withColumn("terms", text.link_terms(F.col("phrase"))).where(F.size("terms") > 0)
    term = p.select("concept_id", "phrase_no", F.size("terms").alias("n"), F.explode("terms").alias("token"))
    total = phrases.select("concept_id").distinct().agg(F.count(F.lit(1)).alias("total"))
    df = term.groupBy("token").agg(F.countDistinct("concept_id").alias("df"))
    idf = df.crossJoin(F.broadcast(total)).select("token", F.log(1 + F.col("total") / F.col("df")).alias("idf"))
    words = texts.select("text_id", F.explode(text.link_terms(F.col("body"))).alias("token"))
    hits = words.join(term.join(idf, "token"), "token").groupBy("text_id", "concept_id", "phrase_no", "n").agg(F.count(F.lit(1)).alias("matched"), F.sum("idf").alias("idf"))
    hits = hits.where(F.col("matched") * 2 >= F.col("n"))
    every = F.col("matched") == F.col("n")
    hits = hits.withColumn("score", F.round(F.col("idf") * F.when(every, 1.5).otherwise(1.0), 3)).withColumn("full", every & ((F.col("n") > 1) | (F.col("idf") >= fixed.LINK_SINGLE_IDF)))
    best = hits.groupBy("text_id", "concept_id").agg(F.min_by(F.struct("score", "full"), F.struct((-F.col("score")).alias("s"), "phrase_no")).alias("b")).select("text_id", "concept_id", "b.*")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("text_id").orderBy(F.desc("score"), "concept_id"))).where(F.col("rank") <= k)
    clear = F.col("full") & (F.col("score") >= fixed.LINK_SCORE)
    everything = Window.partitionBy("text_id")
    first = F.max(F.when(clear, F.col("score"))).over(everything)
    ok = clear & (F.col("score") >= fixed.LINK_SECOND * first)
    nth = F.sum(F.coalesce(ok, F.lit(False)).cast("int")).over(everything.orderBy("rank"))
    return ranked.withColumn("selected", F.coalesce(ok, F.lit(False)) & (nth <= 2))
