"""Queries of the remaining joins, aggregates, sources and sinks on the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import ground, ranges
from ..sources import readers, sinks
from .base import query, table
from .grounding import _content


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j01_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("s_suppkey", "n_name", "r_name")


@query("SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id BETWEEN d.doc_id AND d.doc_id + 2 AND l.doc_id // 10 = d.doc_id // 10 AND l.toxic = 1)")
def j03_flagged_range_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of three places inside a block of ten."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.floor(F.col("doc_id") / 10).alias("k"), (F.col("doc_id") + 2).alias("last"))
    bad = table(spark, sf_dir, "labels").where("toxic = 1").select(F.floor(F.col("doc_id") / 10).alias("k"), F.col("doc_id").alias("at"))
    return ranges.without(d.withColumn("first", F.col("doc_id")), bad, "k", "first", "last", "at", "doc_id").select("doc_id", "lang")


@query("SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id BETWEEN d.doc_id AND d.doc_id + d.n_chars % 120 AND l.toxic = 1)")
def j03_flagged_spans_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of one place to a hundred and twenty, all of one key."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.lit(0).alias("k"), F.col("doc_id").alias("first"), (F.col("doc_id") + F.col("n_chars") % 120).alias("last"))
    bad = table(spark, sf_dir, "labels").where("toxic = 1").select(F.lit(0).alias("k"), F.col("doc_id").alias("at"))
    return ranges.without(d, bad, "k", "first", "last", "at", "doc_id").select("doc_id", "lang")


@query("SELECT l.doc_id, CASE WHEN d.doc_id IS NULL THEN 'unknown_label' ELSE d.source END AS passage FROM (SELECT doc_id + (doc_id % 3) * 100000 AS doc_id FROM labels) l LEFT JOIN documents d USING (doc_id)")
def j10_unknown_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = table(spark, sf_dir, "labels").select((F.col("doc_id") + F.col("doc_id") % 3 * 100000).alias("doc_id"))
    return cited.join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "left").select("doc_id", F.coalesce("source", F.lit("unknown_label")).alias("passage"))


@query("SELECT l_orderkey, l_partkey, min_by(l_linenumber, l_linenumber * 100 + l_suppkey % 100) AS first_owner FROM lineitem GROUP BY ALL")
def j11_first_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.col("l_linenumber") * 100 + F.col("l_suppkey") % 100
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min_by("l_linenumber", order).alias("first_owner"))


@query("SELECT a.p_partkey, CASE WHEN b.p_partkey IS NULL THEN 'missing' WHEN b.p_partkey % 3 = 0 THEN 'ok' ELSE 'wrong_kind' END AS link FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey * 2")
def j16_typed_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey")
    target = p.select(F.col("p_partkey").alias("to"))
    kind = F.when(F.col("to").isNull(), "missing").when(F.col("to") % 3 == 0, "ok").otherwise("wrong_kind")
    return p.join(target, F.col("p_partkey") * 2 == F.col("to"), "left").select("p_partkey", kind.alias("link"))


@query("SELECT p_partkey, array_to_string(list_filter([p_partkey % 7, p_partkey % 11, p_partkey % 13], lambda x: x IN (0, 1, 2, 3)), ' ') AS kept FROM part")
def j18_strip_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kept = F.filter(F.array(k % 7, k % 11, k % 13), lambda x: F.array_contains(F.array(*[F.lit(i).cast("long") for i in range(4)]), x.cast("long")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(kept, lambda x: x.cast("string")), " ").alias("kept"))


@query("SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ' ' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY 1")
def a08_distinct_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), " ").alias("statuses"))


@query("SELECT l_orderkey, q AS best, string_agg(l_linenumber::VARCHAR, ' ' ORDER BY l_linenumber) AS ids FROM (SELECT l_orderkey, l_linenumber, l_quantity::INT % 5 AS q, max(l_quantity::INT % 5) OVER (PARTITION BY l_orderkey) AS m FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity FROM lineitem)) WHERE q = m GROUP BY ALL")
def a09_argmax_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").distinct().select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") % 5).alias("q"))
    best = rows.groupBy("l_orderkey").agg(F.max("q").alias("best"))
    at = rows.join(best, "l_orderkey").where("q = best").groupBy("l_orderkey", "best").agg(F.array_sort(F.collect_list("l_linenumber")).alias("ids"))
    return at.select("l_orderkey", "best", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank, ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS out_of_order FROM events WHERE event_type <> 'error'")
def w01_w11_ranks_and_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    by = Window.partitionBy("user_id")
    return e.select("user_id", "event_id", F.row_number().over(by.orderBy("ts", "event_id")).alias("rank"), (F.col("ts") <= F.lag("ts").over(by.orderBy("event_id"))).alias("out_of_order"))


@query("SELECT doc_id, CASE WHEN list_position(['retrieve', 'needs_clarification', 'not_found'], b) > list_position(['retrieve', 'needs_clarification', 'not_found'], a) THEN b ELSE a END AS decision FROM (SELECT doc_id, ['retrieve', 'needs_clarification', 'not_found'][(doc_id % 3 + 1)::INT] AS a, ['retrieve', 'needs_clarification', 'not_found'][(doc_id // 3 % 3 + 1)::INT] AS b FROM documents)")
def e05_stricter_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(F.lit("retrieve"), F.lit("needs_clarification"), F.lit("not_found"))
    a, b = F.element_at(names, (F.col("doc_id") % 3 + 1).cast("int")), F.element_at(names, (F.floor(F.col("doc_id") / 3) % 3 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", ground.stricter(a, b).alias("decision"))


@query(f"SELECT item_id, array_to_string(list_filter(tl, lambda x, i: list_position(tl, x) = i)[1:6], ' ') AS targets FROM (SELECT item_id, {_content('text')} AS tl FROM benchmark)")
def e06_target_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(ground.target_terms(F.lit(None).cast("string"), F.col("text"), none), " ").alias("targets"))


@query("SELECT user_id AS session_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, min(strftime(ts, '%H:%M:%S')) AS first_clock FROM events GROUP BY ALL")
def k03_s10_trace_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("session_id"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.min(F.date_format("ts", "HH:mm:ss")).alias("first_clock"))


@query("SELECT regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g') AS name, sha256(html) AS sha256, strlen(html) AS byte_count FROM pages")
def k05_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select(F.col("url").alias("name"), F.col("html").cast("binary").alias("content"))
    return sinks.artifacts(files).drop("content")


@query("SELECT conv_id, role, max_by(text, turn) AS last_text FROM conversations GROUP BY ALL")
def s06_last_duplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "role").alias("k"), "turn", F.col("text").alias("last_text"))
    return readers.last_by_key(c, "k", "turn").select("k.conv_id", "k.role", "last_text")


@query("SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS hit FROM documents")
def s13_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"))
    cache = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.col("quality").alias("ordinal"), F.col("toxic").alias("answer"))
    hits, misses = readers.cached(requests, cache)
    return hits.select(F.col("key").alias("doc_id"), F.lit(True).alias("hit")).unionByName(misses.select(F.col("key").alias("doc_id"), F.lit(False).alias("hit")))


@query("SELECT user_id AS session_id, count(*) AS turns, quantile_disc(event_id, 0.5) AS median_event, count_if(event_type = 'error')::BIGINT AS failures FROM events GROUP BY 1")
def z18_latency_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("session_id")).agg(F.count(F.lit(1)).alias("turns"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY event_id)").cast("long").alias("median_event"), F.count_if(F.col("event_type") == "error").alias("failures"))
