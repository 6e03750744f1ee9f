"""Queries of grounding: benchmark items as needs, their best documents as passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import ground, retrieve
from ..staging import staged
from .base import query, quoted, table
from .retrieval import _lexical_sql, items, passages
from .texts import evidence_sql

#: Need types go round by item; every third need has an anchor, the item's first two words.
_TYPE = "[" + quoted(fixed.NEED_TYPES) + "][(item_id % 9 + 1)::INT]"
_TOP = _lexical_sql("overlap / sqrt(greatest(1, n_terms))", 4, "query_id, passage_id, rank")


def _content(x: str) -> str:
    return f"list_filter({evidence_sql(x)}, lambda t: t NOT IN ({quoted(fixed.GENERIC_WORDS)}))"


def needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, need_id, need_type, anchor, description, concepts)."""
    b = table(spark, sf_dir, "benchmark")
    kind = F.element_at(F.array(*[F.lit(x) for x in fixed.NEED_TYPES]), (F.col("item_id") % 9 + 1).cast("int"))
    anchor = F.when(F.col("item_id") % 3 == 0, F.regexp_extract("text", r"^\S+\s\S+", 0))
    return b.select(F.col("item_id").alias("request_id"), F.col("item_id").alias("need_id"), kind.alias("need_type"), anchor.alias("anchor"), F.substring("text", 1, 200).alias("description"), F.array().cast("array<string>").alias("concepts"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each need with the passages that its item retrieves."""
    p = passages(spark, sf_dir)
    found = staged(retrieve.lexical(items(spark, sf_dir), p).select(F.col("query_id").alias("request_id"), "passage_id", "rank"), "found")
    return needs(spark, sf_dir).join(found, "request_id").join(p, "passage_id")


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needs with their passages, level and relatedness, written down: what follows reads them more than once, and the search is run once."""
    args = [F.col(c) for c in ("anchor", "description", "concepts", "body")]
    rows = pairs(spark, sf_dir).withColumn("level", ground.rule_level(F.col("need_type"), *args)).withColumn("related", ground.related(*args))
    return staged(rows, "checks")


_MARKED = "CASE need_type " + " ".join(f"WHEN '{k}' THEN regexp_matches(body, '{p}')" for k, p in fixed.MARKERS.items()) + " ELSE false END"
_SHARE = "CASE WHEN len(target) > 0 THEN len(list_intersect(target, words)) / len(target)::DOUBLE ELSE 0.0 END"
_CHECKS = rf"""top AS ({_TOP}), nd AS (SELECT item_id AS request_id, {_TYPE} AS need_type, CASE WHEN item_id % 3 = 0 THEN nullif(regexp_extract(text, '^\S+\s\S+'), '') END AS anchor, text[1:200] AS description FROM benchmark),
pr0 AS (SELECT nd.*, passage_id, rank, text AS body, {evidence_sql('text')} AS words, {_content('coalesce(anchor, description)')} AS tl, list_distinct({_content('anchor')}) AS names FROM nd JOIN top ON query_id = request_id JOIN documents ON doc_id = passage_id),
pr AS (SELECT *, list_filter(tl, lambda x, i: list_position(tl, x) = i)[1:6] AS target FROM pr0),
ok AS (SELECT *, {_SHARE} AS share, regexp_matches(anchor, '[=^''/+*∫√]|\\[a-zA-Z]+|\d|[a-z]\(|−|-\s*\w') AS formula, contains(lower(body), lower(anchor)) AS literal,
  contains(replace(regexp_replace(lower(body), '[\s\p{{Z}}\x{{85}}\x{{0B}}{{}}$]', '', 'g'), '\', ''), regexp_replace(lower(anchor), '[\s\p{{Z}}{{}}$]', '', 'g')) AS plain, len(names) > 0 AND len(list_intersect(names, words)) / len(names)::DOUBLE >= 0.6 AS mention, {_MARKED} AS marked FROM pr),
ch AS (SELECT *, CASE WHEN NOT (CASE WHEN anchor IS NULL THEN share >= 0.6 ELSE literal OR (formula AND plain) OR (NOT formula AND mention) END) THEN 'not_covered'
  WHEN need_type = 'formula_statement' THEN CASE WHEN anchor IS NOT NULL AND formula AND plain THEN 'covered' ELSE 'partially_covered' END
  WHEN need_type = 'notation_convention' THEN CASE WHEN anchor IS NOT NULL AND marked THEN 'covered' ELSE 'partially_covered' END
  WHEN need_type IN ('definition', 'theorem_statement', 'worked_example', 'exercise') AND marked THEN 'covered' ELSE 'partially_covered' END AS level, coalesce(literal, false) OR share >= 0.3 AS related FROM ok),
cv AS (SELECT request_id, max(CASE level WHEN 'covered' THEN 2 WHEN 'partially_covered' THEN 1 ELSE 0 END) AS best FROM ch GROUP BY 1),
cover AS (SELECT request_id, CASE best WHEN 2 THEN 'covered' WHEN 1 THEN 'partially_covered' ELSE 'not_covered' END AS level, coalesce((SELECT string_agg(passage_id::VARCHAR, ' ' ORDER BY rank) FROM ch WHERE ch.request_id = cv.request_id AND best > 0 AND best = CASE ch.level WHEN 'covered' THEN 2 WHEN 'partially_covered' THEN 1 ELSE 0 END), '') AS ids FROM cv)"""


@query(f"WITH {_CHECKS} SELECT request_id, passage_id, need_type, level, related FROM ch")
def e08_rule_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks(spark, sf_dir).select("request_id", "passage_id", "need_type", "level", "related")


@query(f"WITH {_CHECKS} SELECT request_id, level, ids FROM cover")
def e10_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ground.coverage(checks(spark, sf_dir)).select("request_id", "level", F.array_join("passage_ids", " ").alias("ids"))


def _status(c: DataFrame) -> DataFrame:
    return ground.statuses(ground.coverage(c), c.groupBy("request_id").agg(F.bool_or("related").alias("any_related")))


_STATUS = "st AS (SELECT request_id, CASE WHEN NOT any_related THEN 'no_support_found' WHEN level = 'covered' THEN 'supported' WHEN level <> 'not_covered' THEN 'partial' ELSE 'no_support_found' END AS status FROM cover JOIN (SELECT request_id, bool_or(related) AS any_related FROM ch GROUP BY 1) USING (request_id))"


@query(f"WITH {_CHECKS}, {_STATUS} SELECT request_id, status FROM st")
def e12_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(checks(spark, sf_dir))


@query("SELECT doc_id, concat_ws(' ', CASE WHEN doc_id % 4 = 0 THEN 'unverified_source' END, CASE WHEN doc_id % 5 = 0 THEN 'location_unavailable' END, CASE WHEN toxic = 1 THEN 'source_quality_warning' END, CASE WHEN quality = 0 THEN 'sufficiency_uncertain' END, CASE WHEN doc_id % 6 = 0 THEN 'semantic_channel_unavailable' END, CASE WHEN n_chars > 12000 THEN 'budget_truncated' END) AS codes FROM documents JOIN labels USING (doc_id)")
def e13_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    codes = ground.warnings(F.when(F.col("doc_id") % 4 == 0, "ai_generated"), F.when(F.col("doc_id") % 5 != 0, F.lit(1)), F.col("toxic"), F.when(F.col("quality") == 0, "partially_covered"), F.col("doc_id") % 6 != 0, F.greatest(F.lit(0), F.col("n_chars") - 12000))
    return rows.select("doc_id", F.array_join(codes, " ").alias("codes"))


@query("""SELECT doc_id, coalesce(CASE WHEN doc_id % 11 = 0 THEN 'covered' END, CASE WHEN m = 'on' AND p IS NOT NULL THEN CASE WHEN p >= 0.7 THEN 'covered' WHEN p >= 0.35 THEN 'partially_covered' ELSE 'not_covered' END END, r) AS level
FROM (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 100) / 100.0::DOUBLE END AS p, CASE WHEN doc_id % 2 = 0 THEN 'on' ELSE 'shadow' END AS m, CASE WHEN n_chars > 1000 THEN 'partially_covered' ELSE 'not_covered' END AS r FROM documents)""")
def e14_judge_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 100 / 100.0)
    mode = F.when(F.col("doc_id") % 2 == 0, "on").otherwise("shadow")
    rule = F.when(F.col("n_chars") > 1000, "partially_covered").otherwise("not_covered")
    return table(spark, sf_dir, "documents").select("doc_id", ground.merged(rule, p, mode, F.when(F.col("doc_id") % 11 == 0, "covered")).alias("level"))


@query(f"WITH {_CHECKS}, {_STATUS} SELECT request_id, 'supported with an open need' AS problem FROM st JOIN cover USING (request_id) WHERE status = 'supported' AND level <> 'covered'")
def e16_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = checks(spark, sf_dir)
    return ground.violations(_status(c), c.select("request_id", "passage_id", "rank"), ground.coverage(c))


@query(f"""WITH {_CHECKS}, {_STATUS}, own AS (SELECT request_id AS turn_id, passage_id, status, ch.level FROM ch JOIN st USING (request_id)), lb AS (SELECT request_id AS turn_id, passage_id + (request_id % 2) AS passage_id FROM ch)
SELECT turn_id, passage_id, CASE WHEN status IS NULL OR status NOT IN ('supported', 'partial') THEN 'citation_not_from_turn_bundle' WHEN level = 'covered' THEN 'accepted' WHEN level = 'partially_covered' THEN 'accepted_with_warning' ELSE 'citation_need_not_covered' END AS verdict FROM lb LEFT JOIN own USING (turn_id, passage_id)""")
def e17_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = checks(spark, sf_dir)
    owners = c.join(_status(c), "request_id").select(F.col("request_id").alias("turn_id"), "passage_id", "status", "level", F.lit(0).alias("ordinal"))
    cited = c.select(F.col("request_id").alias("turn_id"), (F.col("passage_id") + F.col("request_id") % 2).alias("passage_id"))
    return ground.citations(cited, owners)


@query(f"WITH top AS ({_TOP}) SELECT query_id AS turn_id, passage_id, 'P' || row_number() OVER (PARTITION BY query_id ORDER BY rank, passage_id) AS label FROM top")
def e19_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieve.lexical(items(spark, sf_dir), passages(spark, sf_dir))
    return ground.labelled(found.select(F.col("query_id").alias("turn_id"), "passage_id", F.col("rank").alias("ordinal")))


_REQ = "SELECT conv_id, turn, CASE WHEN turn % 5 <> 0 THEN 'src' || (conv_id % 25) END AS course, CASE WHEN turn % 4 = 3 THEN 'chat' ELSE 'answer_grounding' END AS purpose, text, (turn % 12)::INT AS top_k, (conv_id % 6)::INT AS n_needs FROM conversations"


@query(f"""SELECT conv_id, turn, concat_ws(' ', CASE WHEN trim(text) = '' THEN 'missing_query' END, CASE WHEN course IS NULL THEN 'missing_course' END, CASE WHEN k.source IS NULL THEN 'unknown_course' END, CASE WHEN purpose NOT IN ({quoted(fixed.PURPOSES)}) THEN 'unknown_purpose' END,
 CASE WHEN length(text) > 2000 THEN 'query_too_long' END, CASE WHEN top_k NOT BETWEEN 1 AND 10 THEN 'top_k_out_of_range' END, CASE WHEN n_needs NOT BETWEEN 1 AND 4 THEN 'need_count_out_of_range' END) AS errors FROM ({_REQ}) LEFT JOIN (SELECT DISTINCT source FROM documents) k ON k.source = course""")
def e01_request_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    courses = table(spark, sf_dir, "documents").select(F.col("source").alias("course")).distinct().withColumn("known", F.lit(True))
    c = table(spark, sf_dir, "conversations").withColumn("course", F.when(F.col("turn") % 5 != 0, F.concat(F.lit("src"), (F.col("conv_id") % 25).cast("string"))))
    c = c.withColumn("purpose", F.when(F.col("turn") % 4 == 3, "chat").otherwise("answer_grounding")).join(courses, "course", "left")
    errors = ground.request_errors(F.col("course"), F.col("purpose"), F.col("text"), F.col("turn") % 12, F.col("conv_id") % 6, F.col("known"))
    return c.select("conv_id", "turn", F.array_join(errors, " ").alias("errors"))


@query(r"""SELECT conv_id, turn, CASE WHEN turn % 12 = 11 THEN 'invalid_request' WHEN conv_id % 9 = 0 THEN 'course_not_ready' WHEN conv_id % 7 = 0 THEN 'version_mismatch' WHEN conv_id % 5 = 0 THEN 'no_eligible_sources' WHEN conv_id % 6 = 0 THEN 'reference_only'
 WHEN regexp_matches(q, '[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]') THEN 'query_language_unsupported' WHEN sc = 'needs_clarification' THEN 'needs_clarification' WHEN sc = 'not_found' THEN 'excluded_scope' END AS stop, sc AS scope
 FROM (SELECT *, CASE WHEN regexp_matches(q, '(?i)calculus\s+(ii|2|two)\b') THEN 'not_found' WHEN regexp_matches(q, '(?i)second\s+semester') THEN 'needs_clarification' WHEN regexp_matches(q, '(?i)\b(instructor|lecture)\b.*\b(say|said)\b|\b(say|said)\b.*\b(instructor|lecture)\b') THEN 'not_found' ELSE 'retrieve' END AS sc
 FROM (SELECT conv_id, turn, replace(text, chr(10), ' ') || CASE WHEN turn % 3 = 0 THEN ' Calculus 2' WHEN turn % 3 = 1 AND conv_id % 2 = 0 THEN ' in the second semester' WHEN conv_id % 4 = 1 THEN ' 微' ELSE '' END AS q FROM conversations))""")
def e02_e04_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, t = F.col("conv_id"), F.col("turn")
    q = F.concat(F.replace("text", F.lit("\n"), F.lit(" ")), F.when(t % 3 == 0, " Calculus 2").when((t % 3 == 1) & (n % 2 == 0), " in the second semester").when(n % 4 == 1, " 微").otherwise(""))
    rows = table(spark, sf_dir, "conversations").withColumn("q", q).withColumn("scope", ground.scope_decision(F.col("q")))
    errors = F.when(t % 12 == 11, F.array(F.lit("bad"))).otherwise(F.array().cast("array<string>"))
    stop = ground.preflight(errors, n % 9 != 0, F.when(n % 7 == 0, "v0"), F.lit("v1"), F.when(n % 5 == 0, 0).otherwise(3), F.when(n % 6 == 0, 3).otherwise(1), F.col("q"), F.col("scope"))
    return rows.select("conv_id", "turn", stop.alias("stop"), "scope")


@query(r"""WITH n AS (SELECT doc_id, trim(regexp_replace(text, '[\s\p{Z}\x{85}\x{0B}]+', ' ', 'g')) AS b FROM documents), g AS (SELECT item_id, trim(regexp_replace(text, '[\s\p{Z}\x{85}\x{0B}]+', ' ', 'g')) AS a, string_split(a, ' ')[1:5] AS f FROM benchmark)
SELECT item_id, count(doc_id) AS n_documents, min(doc_id) AS first_document FROM g LEFT JOIN n ON contains(b, a) GROUP BY item_id""")
def j09_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items meet the documents that hold their words 2 to 5, which stand whole in any text that contains an item of six words; containment is then tested on these.
    Shorter items are looked for in every document."""
    words = lambda x: F.split(x, " ")
    docs = table(spark, sf_dir, "documents").select("doc_id", text.collapsed(F.col("text")).alias("body"))
    # the words are bound once: as an expression they would be cut anew for each place
    runs_of = F.transform(F.array(words("body")), lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(x) - 3)), lambda i: F.array_join(F.slice(x, i, 4), " ")))
    gold = table(spark, sf_dir, "benchmark").select("item_id", text.collapsed(F.col("text")).alias("anchor"))
    long = F.size(words("anchor")) >= 6
    asked = staged(gold.where(long).withColumn("run", F.array_join(F.slice(words("anchor"), 2, 4), " ")), "asked")
    met = staged(docs.select("doc_id", F.explode(runs_of[0]).alias("run")).join(asked, "run").select("item_id", "anchor", "doc_id").distinct(), "met")
    far = met.join(docs, "doc_id").where(F.contains("body", F.col("anchor"))).select("item_id", "doc_id")
    near = docs.join(gold.where(~long), F.contains("body", F.col("anchor"))).select("item_id", "doc_id")
    hits = far.unionByName(near).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.min("doc_id").alias("first_document"))
    return gold.select("item_id").join(hits, "item_id", "left").select("item_id", F.coalesce("n_documents", F.lit(0)).cast("long").alias("n_documents"), "first_document")
