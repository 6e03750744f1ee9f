"""Queries of evaluation and plain aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, retrieve
from ..functions import text
from ..staging import staged
from .base import query, table
from .retrieval import _lexical_sql, items, passages


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT n_chars > 1000 AS predicted, quality = 1 AS actual, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def a02_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(_judged(spark, sf_dir).select((F.col("n_chars") > 1000).alias("predicted"), (F.col("quality") == 1).alias("actual")))


@query("SELECT lang, count(*) AS n, count_if(ok)::BIGINT AS n_ok, round(count_if(ok) / count(*)::DOUBLE, 6) AS accuracy FROM (SELECT lang, (n_chars > 1000) = (quality = 1) AS ok FROM documents JOIN labels USING (doc_id)) GROUP BY GROUPING SETS ((), (lang))")
def a03_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.by_kind(_judged(spark, sf_dir).select("lang", ((F.col("n_chars") > 1000) == (F.col("quality") == 1)).alias("ok")), "lang")


_T = [round(0.1 * i, 1) for i in range(1, 10)]


@query(f"SELECT t AS threshold, count_if(p >= t AND q)::BIGINT AS hits, count_if(p >= t AND NOT q)::BIGINT AS false_alarms, count_if(p < t AND q)::BIGINT AS misses FROM (SELECT (n_chars % 1000) / 1000.0::DOUBLE AS p, quality = 1 AS q FROM documents JOIN labels USING (doc_id)), (SELECT unnest({_T}::DOUBLE[]) AS t) GROUP BY t")
def a04_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.sweep(_judged(spark, sf_dir).select((F.col("n_chars") % 1000 / 1000.0).alias("p"), (F.col("quality") == 1).alias("truth")), _T)


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars, max(n_chars) AS longest, string_agg(DISTINCT lang, ' ' ORDER BY lang) AS langs FROM documents GROUP BY 1")
def a01_a16_a17_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"), F.array_join(F.array_sort(F.collect_set("lang")), " ").alias("langs"))


@query("SELECT conv_id, bool_or(role = 'system') AS any_system, bool_and(length(text) > 3) AS all_long FROM conversations GROUP BY 1")
def a05_any_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.bool_or(F.col("role") == "system").alias("any_system"), F.bool_and(F.length("text") > 3).alias("all_long"))


@query("SELECT token, count(DISTINCT doc_id) AS df, round(ln(1 + (SELECT count(*) FROM documents) / count(DISTINCT doc_id)::DOUBLE), 6) AS idf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS token FROM documents) GROUP BY token")
def a06_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    total = docs.agg(F.count(F.lit(1)).alias("total"))
    df = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(total)).select("token", "df", F.round(F.log(1 + F.col("total") / F.col("df")), 6).alias("idf"))


@query("SELECT o_custkey AS id, (min((o_orderdate, o_orderkey))).o_orderkey AS first_order, (max((o_orderdate, o_orderkey))).o_orderkey AS last_order FROM (SELECT o_custkey, o_orderdate, o_orderkey FROM orders) GROUP BY 1".replace("(min((o_orderdate, o_orderkey))).o_orderkey", "min({'d': o_orderdate, 'k': o_orderkey}).k").replace("(max((o_orderdate, o_orderkey))).o_orderkey", "max({'d': o_orderdate, 'k': o_orderkey}).k"))
def a07_lexicographic_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.struct("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min(s).alias("a"), F.max(s).alias("b")).select("id", F.col("a.o_orderkey").alias("first_order"), F.col("b.o_orderkey").alias("last_order"))


@query("SELECT event_type AS provider, count(*) AS calls, count_if(event_id % 4 = 0)::BIGINT AS cached, sum(event_id % 500)::BIGINT AS tokens, round(sum((event_id % 500) * 0.042::DOUBLE / 1000000), 6) AS cost, round(avg(event_id % 300), 3) AS mean_ms FROM events GROUP BY 1")
def a12_a15_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_id") % 500
    return evaluate.usage(table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), (F.col("event_id") % 4 == 0).alias("cached"), t.alias("tokens"), (t * 0.042 / 1_000_000).alias("cost"), (F.col("event_id") % 300).alias("ms")))


_GOLD = "SELECT query_id AS question_id, passage_id // 2 % 2 AS group_id, passage_id FROM lx WHERE rank <= 3"


@query(f"WITH lx AS ({_lexical_sql('overlap / sqrt(greatest(1, n_terms))', 4, 'query_id, passage_id, rank')}), g AS ({_GOLD}) SELECT question_id, bool_and(f) AS complete, count(*) AS n_groups FROM (SELECT question_id, group_id, bool_or(r.passage_id IS NOT NULL) AS f FROM g LEFT JOIN (SELECT * FROM lx WHERE rank <= 2) r ON r.query_id = g.question_id AND r.passage_id = g.passage_id GROUP BY ALL) GROUP BY question_id")
def a14_complete_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = staged(retrieve.lexical(items(spark, sf_dir), passages(spark, sf_dir)).select(F.col("query_id").alias("question_id"), "passage_id", "rank"), "found")
    gold = found.where("rank <= 3").select("question_id", (F.floor(F.col("passage_id") / 2) % 2).alias("group_id"), "passage_id")
    return evaluate.complete_at(found, gold, 2)


@query("SELECT source AS course_id, count(*) AS n_documents, sum(nl)::BIGINT AS n_lines, max(nl) AS longest FROM (SELECT source, len(string_split(text, chr(10))) AS nl FROM documents) GROUP BY 1")
def a18_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.split("text", "\n", -1)).cast("long")
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("course_id")).agg(F.count(F.lit(1)).alias("n_documents"), F.sum(n).alias("n_lines"), F.max(n).alias("longest"))


@query("SELECT token, min(pos) AS first_pos, count(*) AS n FROM (SELECT unnest(ts) AS token, unnest(range(0, len(ts))) AS pos FROM (SELECT regexp_extract_all(lower(text), '[a-z]+') AS ts FROM benchmark)) GROUP BY token")
def a10_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select(F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("pos", "token"))
    return rows.groupBy("token").agg(F.min("pos").cast("long").alias("first_pos"), F.count(F.lit(1)).alias("n"))


__all__ = ["text"]
