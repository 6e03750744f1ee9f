"""Queries of course graphs: parts as concepts, suppliers as modules, line items as prerequisite edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import context, ranges
from .base import query, table
from .segmentation import blocks


@query("SELECT 'V-04' AS rule, id AS \"where\", 'duplicate id' AS message FROM (SELECT split_part(p_name, ' ', 1) || '.' || (p_partkey % 50) AS id FROM part) GROUP BY id HAVING count(*) > 1")
def c04_duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "part").select(F.concat(F.split("p_name", " ")[0], F.lit("."), (F.col("p_partkey") % 50).cast("string")).alias("id"))
    return context.duplicate_ids(ids)


@query("SELECT 'V-04' AS rule, id AS \"where\", 'id does not begin with its parent''s' AS message FROM (SELECT 'm' || (p_partkey % 10) || '.c' || p_partkey AS id, 'm' || (p_partkey % 11) AS parent FROM part) WHERE NOT starts_with(id, parent || '.')")
def c04_misplaced_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    ids = table(spark, sf_dir, "part").select(F.concat(F.lit("m"), (k % 10).cast("string"), F.lit(".c"), k.cast("string")).alias("id"), F.concat(F.lit("m"), (k % 11).cast("string")).alias("parent_id"))
    return context.misplaced_ids(ids)


@query("SELECT 'V-05' AS rule, l_partkey::VARCHAR AS \"where\", 'unknown ' || l_suppkey AS message FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0)")
def c05_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    return context.dangling(links, table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("id")))


@query("SELECT 'V-06' AS rule, o_orderkey::VARCHAR AS \"where\", 'not listed by ' || o_custkey AS message FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def c06_reverse_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("parent_id"), F.col("o_orderkey").alias("id"))
    listed = o.join(table(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("id")).distinct(), "id", "left_semi")
    return context.unlisted(o, listed.select("parent_id", "id"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prerequisites among parts: mostly of a later part, with some back edges and loops."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("src"), F.when(k % 97 == 0, k).when(k % 31 == 0, k + 1).when(k % 31 == 1, k - 1).otherwise(F.floor(k / 2)).cast("long").alias("dst"))


_EDGES = "(SELECT p_partkey AS src, (CASE WHEN p_partkey % 97 = 0 THEN p_partkey WHEN p_partkey % 31 = 0 THEN p_partkey + 1 WHEN p_partkey % 31 = 1 THEN p_partkey - 1 ELSE p_partkey // 2 END)::BIGINT AS dst FROM part)"


@query(f"""SELECT 'V-07' AS rule, src::VARCHAR AS "where", CASE WHEN src = dst THEN 'self prerequisite' ELSE 'prerequisite from a later module' END || ' ' || dst AS message FROM {_EDGES} e JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE src = dst OR dst % 20 > src % 20""")
def c07_prereq_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 20).alias("place"))
    return context.prerequisite_order(edges(spark, sf_dir), order)


@query(f"WITH RECURSIVE e AS {_EDGES}, r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT DISTINCT src AS id FROM r WHERE src = dst")
def c08_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.on_cycles(edges(spark, sf_dir))


_ASSUMED = "SELECT doc_id AS ordinal, CASE WHEN doc_id % 3 = 0 THEN 'Course' ELSE 'Concept' END AS entity, 'c' || (doc_id % 40) || CASE WHEN doc_id % 17 = 0 THEN '.*' ELSE '' END AS id, CASE WHEN doc_id % 3 = 0 THEN 'assumed_background' WHEN doc_id % 3 = 1 THEN 'difficulty_notes' ELSE 'summary' END AS field, CASE WHEN doc_id % 7 < 3 THEN CASE WHEN quality = 1 THEN 'high' ELSE 'low' END WHEN doc_id % 7 < 5 THEN 'medium' END AS confidence, 'r' || (doc_id % 4) AS reason FROM labels"


@query(f"""WITH a AS ({_ASSUMED}), f AS (SELECT * FROM a WHERE ((entity = 'Concept' AND field = 'difficulty_notes') OR (entity = 'Course' AND field = 'assumed_background')) AND id NOT LIKE '%.*' AND coalesce(confidence <> 'high', true)),
d AS (SELECT entity, id, field, reason, min(ordinal) AS o FROM f GROUP BY ALL), g AS (SELECT entity, id, field, string_agg(reason, '; ' ORDER BY o) AS reasons FROM d GROUP BY ALL),
c AS (SELECT entity, id, field, first(confidence ORDER BY ordinal) AS confidence FROM f GROUP BY ALL)
SELECT entity, id, field, confidence, reasons, row_number() OVER (ORDER BY CASE confidence WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, id, field) AS place FROM g JOIN c USING (entity, id, field)""")
def c11_review_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").select(
        n.alias("ordinal"), F.when(n % 3 == 0, "Course").otherwise("Concept").alias("entity"), F.concat(F.lit("c"), (n % 40).cast("string"), F.when(n % 17 == 0, ".*").otherwise("")).alias("id"),
        F.when(n % 3 == 0, "assumed_background").when(n % 3 == 1, "difficulty_notes").otherwise("summary").alias("field"),
        F.when(n % 7 < 3, F.when(F.col("quality") == 1, "high").otherwise("low")).when(n % 7 < 5, "medium").alias("confidence"), F.concat(F.lit("r"), (n % 4).cast("string")).alias("reason"),
    )
    return context.worklist(rows)


@query("SELECT 'V-09' AS rule, a.id AS \"where\", 'matches no entity' AS message FROM (SELECT DISTINCT 'm' || (doc_id % 25) || '.*' AS id FROM labels) a WHERE NOT EXISTS (SELECT 1 FROM part WHERE starts_with('m' || (p_partkey % 20) || '.c', replace(a.id, '*', '')))")
def c09_wildcards(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "labels").select(F.concat(F.lit("m"), (F.col("doc_id") % 25).cast("string"), F.lit(".*")).alias("id")).distinct()
    known = table(spark, sf_dir, "part").select(F.concat(F.lit("m"), (F.col("p_partkey") % 20).cast("string"), F.lit(".")).alias("prefix")).distinct()
    open_ = a.withColumn("prefix", F.replace("id", F.lit("*"), F.lit(""))).join(known, "prefix", "left_anti")
    return context.finding(open_, "V-09", F.col("id"), "matches no entity")


@query("SELECT o_custkey AS module_id, string_agg(o_orderkey::VARCHAR, ' ' ORDER BY o_orderkey) AS concept_ids, count(*) AS n FROM orders GROUP BY 1")
def c12_a13_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("module_id")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    return by.select("module_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("concept_ids"), F.size("ids").cast("long").alias("n"))


@query(f"SELECT src AS id, string_agg(dst::VARCHAR, ' ' ORDER BY dst) AS added FROM {_EDGES} WHERE src <> dst AND dst % 20 < src % 20 AND dst IN (SELECT p_partkey FROM part) GROUP BY 1")
def c13_cross_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir).where("src <> dst AND dst % 20 < src % 20").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("dst")), "dst", "left_semi")
    return e.groupBy(F.col("src").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("dst")), lambda x: x.cast("string")), " ").alias("added"))


@query("SELECT doc_id, coalesce(CASE WHEN toxic = 1 THEN 'patched' END, lang) AS lang, coalesce(CASE WHEN quality = 0 THEN 'low' END, source) AS source FROM documents LEFT JOIN labels USING (doc_id)")
def c14_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    patch = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "patched").alias("new_lang"), F.when(F.col("quality") == 0, "low").alias("new_source"))
    return table(spark, sf_dir, "documents").join(patch, "doc_id", "left").select("doc_id", F.coalesce("new_lang", "lang").alias("lang"), F.coalesce("new_source", "source").alias("source"))


@query("SELECT p_partkey AS concept_id, 'Explain ' || p_name AS question, (SELECT q.p_name FROM part q WHERE q.p_partkey = p.p_partkey // 2) AS prerequisite, 'confuses ' || split_part(p_name, ' ', 1) || ' / revisit ' || coalesce(split_part(p_name, ' ', 2), '') AS cue FROM part p")
def c15_question_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    before = p.select(F.col("p_partkey").alias("pre"), F.col("p_name").alias("prerequisite"))
    words = F.split("p_name", " ")
    cues = F.zip_with(F.slice(words, 1, 1), F.slice(words, 2, 1), lambda a, b: F.concat(F.lit("confuses "), a, F.lit(" / revisit "), F.coalesce(b, F.lit(""))))
    return p.join(before, F.floor(p.p_partkey / 2) == before.pre, "left").select(F.col("p_partkey").alias("concept_id"), F.concat(F.lit("Explain "), "p_name").alias("question"), "prerequisite", cues[0].alias("cue"))


@query("SELECT o_orderkey, concat_ws(' ', CASE WHEN o_totalprice IS NULL THEN 'missing_price' END, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'bad_status' END, CASE WHEN o_totalprice > 300000 THEN 'too_large' END) AS errors FROM orders")
def c16_c18_record_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = F.array_compact(F.array(F.when(F.col("o_totalprice").isNull(), F.lit("missing_price")), F.when(~F.col("o_orderstatus").isin("O", "F"), F.lit("bad_status")), F.when(F.col("o_totalprice") > 300000, F.lit("too_large"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(errors, " ").alias("errors"))


@query("WITH g AS (SELECT p_partkey AS q, 'method' AS kind, 0 AS i FROM part UNION ALL SELECT p_partkey, 'prerequisite', unnest(range(0, p_partkey % 3)) FROM part UNION ALL SELECT p_partkey, 'mastery', unnest(range(0, least(2, p_partkey % 4))) FROM part) SELECT q AS question_id, kind, i::INT AS i, q || ':' || kind || ':' || i AS gap_id FROM g")
def c17_gap_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    times = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    parts = [p.select(k.alias("question_id"), F.lit(kind).alias("kind"), F.explode(times(n.cast("int"))).alias("i")) for kind, n in (("method", F.lit(1)), ("prerequisite", k % 3), ("mastery", F.least(F.lit(2), k % 4)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("gap_id", F.concat_ws(":", F.col("question_id").cast("string"), "kind", F.col("i").cast("string")))


@query("SELECT l_orderkey || '#' || o AS \"where\", CASE WHEN q > 48 THEN 'span' ELSE 'overlap' END AS rule, CASE WHEN q > 48 THEN 'span outside its page' ELSE 'overlaps the block before it' END AS message FROM (SELECT *, max(CASE WHEN q <= 48 THEN q END) OVER (PARTITION BY l_orderkey ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m, last_value(CASE WHEN q <= 48 THEN q END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lst FROM (SELECT DISTINCT l_orderkey, l_linenumber::BIGINT * 1000000000 + l_partkey::BIGINT * 100 + l_quantity::INT AS o, l_quantity::INT AS q FROM lineitem)) WHERE q > 48 OR q <= lst")
def c19_w06_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey").cast("long") * 100 + q).alias("ordinal"), F.lit(1).alias("page_number"), q.alias("line_start"), q.alias("line_end")).distinct()
    pages = b.select("document_id").distinct().withColumn("page_number", F.lit(1)).withColumn("n_lines", F.lit(48))
    return context.span_findings(b, pages)


@query("SELECT 's' || s_suppkey AS id, r_name || ' > ' || n_name || ' > ' || s_name AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || n_nationkey, r_name || ' > ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'r' || r_regionkey, r_name FROM region")
def c20_section_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("title"))
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), "n_name")
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), "s_name")
    return context.paths(r.union(n).union(s))


_HEAD = "CASE WHEN doc_id % 4 = 0 THEN '110.108' WHEN doc_id % 41 = 0 THEN '550.413' END"


@query(f"""WITH s AS (SELECT source AS course_id, CASE WHEN num IS NOT NULL THEN CASE WHEN num = '110.108' THEN 'verified' ELSE 'conflict' END WHEN tk <> '' THEN CASE WHEN tk = 'calculus' THEN 'verified' ELSE 'conflict' END ELSE 'uncertain' END AS st FROM (SELECT source, {_HEAD} AS num, CASE WHEN doc_id % 3 = 0 THEN 'calculus' WHEN doc_id % 43 = 0 THEN 'biology' ELSE '' END AS tk FROM documents))
SELECT course_id, count_if(st = 'conflict')::BIGINT AS conflicts, count_if(st = 'uncertain')::BIGINT AS uncertain, CASE WHEN count_if(st = 'conflict') > 0 THEN 'rejected' WHEN count_if(st = 'uncertain') > 0 THEN 'partially_verified' ELSE 'verified' END AS status FROM s GROUP BY 1""")
def c21_course_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    number = F.when(n % 4 == 0, "110.108").when(n % 41 == 0, "550.413")
    title = F.when(n % 3 == 0, "Lecture Notes Calculus").when(n % 43 == 0, "Biology Class")
    tokens = F.coalesce(text.identity_tokens(title), F.array().cast("array<string>"))
    state = context.consistency(text.canonical_number(number), tokens, F.lit("110108"), F.array(F.lit("calculus")))
    return context.course_status(table(spark, sf_dir, "documents").select(F.col("source").alias("course_id"), state.alias("state")))


@query("SELECT l_orderkey AS exercise FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'N') a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = 'R')")
def j17_not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("exercise")).distinct().join(li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("exercise")), "exercise", "left_anti")


@query("SELECT d.doc_id, count(l.l_linenumber) AS n_issues, coalesce(string_agg(l.l_linenumber::VARCHAR, ' ' ORDER BY l.l_linenumber, l.l_suppkey), '') AS lines FROM documents d LEFT JOIN lineitem l ON l.l_orderkey = d.doc_id AND l.l_linenumber BETWEEN 2 AND 2 + d.doc_id % 3 AND l.l_returnflag <> 'R' GROUP BY 1")
def j02_open_issues_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("k"), F.lit(2).cast("long").alias("first"), (2 + F.col("doc_id") % 3).alias("last"))
    li = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_suppkey")
    hit = ranges.inside(d, li, "k", "first", "last", "l_linenumber")
    by = hit.groupBy("doc_id").agg(F.count("l_linenumber").alias("n"), F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("x"))
    lines = F.array_join(F.transform("x", lambda s: s["l_linenumber"].cast("string")), " ")
    return d.join(by, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_issues"), F.coalesce(lines, F.lit("")).alias("lines"))


@query("""SELECT d.doc_id, count(l.doc_id) AS n_flagged, min(l.doc_id) AS first_flagged FROM documents d
LEFT JOIN labels l ON l.doc_id BETWEEN d.doc_id AND d.doc_id + (d.n_chars * 7 % 900) AND l.toxic = 1 GROUP BY 1""")
def j02_issues_in_long_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans from one place to nine hundred, all of one key."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("k"), F.col("doc_id").alias("first"), (F.col("doc_id") + F.col("n_chars") * 7 % 900).alias("last"))
    flagged = table(spark, sf_dir, "labels").where("toxic = 1").select(F.lit(0).alias("k"), F.col("doc_id").alias("at"))
    by = ranges.inside(d, flagged, "k", "first", "last", "at").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_flagged"))
    return d.select("doc_id").join(by, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_flagged"), "first_flagged")


@query("SELECT d.doc_id, d.lang, max_by(i.quality, i.doc_id) AS last_quality FROM documents d JOIN labels i ON i.doc_id % 500 = d.doc_id % 500 AND i.doc_id <= d.doc_id GROUP BY ALL")
def j04_last_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("doc_id") % 500).alias("k"), F.col("doc_id").alias("at"))
    i = table(spark, sf_dir, "labels").select((F.col("doc_id") % 500).alias("k"), F.col("doc_id").alias("at"), "quality")
    found = ranges.last_before(d, i, "k", "at", "last")
    return found.where("last IS NOT NULL").select("doc_id", "lang", F.col("last.quality").alias("last_quality"))


@query("""SELECT c.click_id, max_by(s.sale_id, (s.sold_at, s.sale_id)) AS sale_id FROM (SELECT DISTINCT click_id, client_id, ts FROM clicks) c
LEFT JOIN sales s ON s.client_id = c.client_id AND s.sold_at <= c.ts GROUP BY 1""")
def j04_last_sale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last sale of its client at or before each click: keys from one row to a third of all."""
    seconds = lambda c: F.unix_date(F.col(c).cast("date")).cast("long") * 86_400_000_000 + (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), F.col(c)) * 1_000_000).cast("long")
    clicks = table(spark, sf_dir, "clicks").select("click_id", "client_id", seconds("ts").alias("at")).distinct()
    sales = table(spark, sf_dir, "sales").select("client_id", seconds("sold_at").alias("at"), "sale_id")
    return ranges.last_before(clicks, sales, "client_id", "at", "last").select("click_id", F.col("last.sale_id").alias("sale_id"))


_DEEP = "SELECT doc_id AS id, CASE WHEN doc_id % 1000 = 0 THEN NULL ELSE doc_id - 1 - doc_id % 2 * (doc_id % 1000 > 1)::INT END AS parent_id, source AS title FROM documents"


@query(f"WITH RECURSIVE n AS ({_DEEP}), up(id, path) AS (SELECT id, title FROM n WHERE parent_id IS NULL UNION ALL SELECT n.id, up.path || ' > ' || n.title FROM up JOIN n ON n.parent_id = up.id) SELECT id, md5(path) AS path_md5, length(path) AS path_length FROM up")
def c20_deep_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections some hundred levels deep, a tree for every thousand documents."""
    n = F.col("doc_id")
    parent = F.when(n % 1000 != 0, n - 1 - n % 2 * (n % 1000 > 1).cast("long"))
    found = context.paths(table(spark, sf_dir, "documents").select(n.alias("id"), parent.alias("parent_id"), F.col("source").alias("title")))
    return found.select("id", F.md5(F.col("path").cast("binary")).alias("path_md5"), F.length("path").cast("long").alias("path_length"))


@query("SELECT n_nationkey AS section_id, n_regionkey AS parent_id, n_nationkey % 5 = n_regionkey AS inside FROM nation JOIN region ON r_regionkey = n_regionkey")
def j14_parent_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("section_id"), F.col("n_regionkey").alias("parent_id"), (F.col("n_nationkey") % 5 == F.col("n_regionkey")).alias("inside"))


__all__ = ["blocks", "edges", "fixed"]
