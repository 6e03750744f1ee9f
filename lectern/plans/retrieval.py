"""Queries of the retrieval channels, fusion and budgets: benchmark items search the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, porter, text
from ..operators import nearest, postings, retrieve
from .base import query, quoted, table
from .texts import LEXICAL, stem_sql


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def passages(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("passage_id"), F.col("text").alias("body"), *more)


_PAIRS = f"""q AS (SELECT item_id AS query_id, unnest({LEXICAL.format('text')}) AS token FROM benchmark),
d0 AS (SELECT doc_id AS passage_id, lang, source, n_chars, {LEXICAL.format('text')} AS ts FROM documents),
d AS (SELECT passage_id, lang, source, n_chars, len(ts) AS n_terms, unnest(ts) AS token FROM d0),
pairs AS (SELECT query_id, passage_id, lang, source, n_chars, n_terms, count(*) AS overlap FROM q JOIN d USING (token) GROUP BY ALL)"""


def _lexical_sql(score: str, k: int, out: str = "query_id, passage_id, rank::INT AS rank, round(score, 4) AS score, overlap") -> str:
    return f"WITH {_PAIRS}, s AS (SELECT *, {score} AS score FROM pairs), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM s) SELECT {out} FROM r WHERE rank <= {k}"


@query(_lexical_sql("overlap / sqrt(greatest(1, n_terms))", 4))
def r01_lexical_top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.lexical(items(spark, sf_dir), passages(spark, sf_dir))


@query(_lexical_sql("overlap / sqrt(greatest(1, n_terms)) * CASE WHEN lang = 'en' THEN 2.0 ELSE 1.0 END", 4))
def r01_lexical_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.lexical(items(spark, sf_dir), passages(spark, sf_dir, "lang"), boost=F.col("lang") == "en")


@query(f"""WITH {_PAIRS}, n AS (SELECT query_id, count(*) AS n FROM q GROUP BY 1),
r AS (SELECT query_id, passage_id, overlap, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, passage_id) AS rank FROM pairs JOIN n USING (query_id) WHERE overlap >= ceil(n * 0.6))
SELECT query_id, passage_id, overlap, rank FROM r WHERE rank <= 4""")
def r03_fixture_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.fixture_overlap(items(spark, sf_dir), passages(spark, sf_dir), 4)


def _nearest(spark: SparkSession, sf_dir: str, search) -> DataFrame:
    """The 40 nearest records of every row whose id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vec"))
    r = e.select(F.col("vec_id").alias("record_id"), F.col("embedding").alias("r_vec"))
    return search(q, r).withColumn("similarity", F.round("similarity", 6))


@query("""WITH s AS (SELECT q.vec_id AS query_id, r.vec_id AS record_id, round(list_dot_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 9) AS sim FROM embeddings q JOIN embeddings r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, record_id) AS rank FROM s) SELECT query_id, record_id, rank, round(sim, 6) AS similarity FROM r WHERE rank <= 40""")
def r04_vector_top40(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By cells, those that cannot hold a neighbour left out."""
    return _nearest(spark, sf_dir, nearest.nearest)


@query("""WITH s AS (SELECT q.vec_id AS query_id, r.vec_id AS record_id, round(list_dot_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]), 9) AS sim FROM embeddings q JOIN embeddings r ON q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, record_id) AS rank FROM s) SELECT query_id, record_id, rank, round(sim, 6) AS similarity FROM r WHERE rank <= 40""")
def r04_vector_top40_each20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by comparing all blocks."""
    return _nearest(spark, sf_dir, retrieve.vector)


_WORDS = f"list_transform(list_filter(regexp_extract_all(lower({{}}), '[a-z0-9]+'), lambda t: t NOT IN ({quoted(fixed.FULL_TEXT_STOP)})), lambda t: {stem_sql()})"
_BM25 = f"""p AS (SELECT doc_id AS passage_id, {_WORDS.format('text')} AS w FROM documents), st AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM p),
tf AS (SELECT passage_id, dl, token, count(*) AS tf FROM (SELECT passage_id, len(w) AS dl, unnest(w) AS token FROM p) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
bq AS (SELECT item_id AS query_id, unnest(list_distinct({_WORDS.format('text')})) AS token FROM benchmark),
bs AS (SELECT query_id, passage_id, round(sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM bq JOIN tf USING (token) JOIN df USING (token), st GROUP BY ALL),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM bs QUALIFY rank <= {{k}})"""


@query(f"WITH {_BM25.format(k=10)} SELECT query_id, passage_id, score, rank FROM bm")
def r05_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.full_text(items(spark, sf_dir), passages(spark, sf_dir), 10)


_LATIN = f"regexp_extract_all(translate(lower({{}}), '{postings.MARKED}', '{postings.PLAIN}'), '[\\p{{{{L}}}}\\p{{{{N}}}}]+')"


def _search_sql(phrases: str, wants: str, k: int = 10) -> str:
    """Search in SQL; `phrases` is a list of lists of words over the item's words w."""
    tokens = "SELECT DISTINCT word FROM (SELECT unnest(w) AS word FROM pw UNION ALL SELECT unnest(flatten(ph)) FROM qw)"
    return f"""WITH pw AS (SELECT doc_id AS passage_id, {_LATIN.format("coalesce(text, '')")} AS w FROM documents),
qw AS (SELECT item_id AS query_id, {phrases} AS ph FROM (SELECT item_id, {_LATIN.format('text')} AS w FROM benchmark)),
{porter.stems_sql(tokens, 'st')},
pp AS (SELECT passage_id, dl, pos, stem AS token FROM (SELECT passage_id, len(w) AS dl, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM pw) JOIN st USING (word)),
q0 AS (SELECT query_id, unnest(ph) AS ws, generate_subscripts(ph, 1) AS phrase FROM qw),
q1 AS (SELECT query_id, phrase, list(stem ORDER BY place) AS tokens FROM (SELECT query_id, phrase, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM q0) JOIN st USING (word) GROUP BY ALL),
q2 AS (SELECT query_id, min(phrase) AS phrase, tokens FROM q1 GROUP BY query_id, tokens),
q AS (SELECT *, {wants} AS wants, len(tokens) AS size FROM q2),
qt AS (SELECT query_id, phrase, wants, size, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM q),
f AS (SELECT query_id, phrase, wants, passage_id, dl, count(*) AS hits FROM (
  SELECT query_id, phrase, wants, size, passage_id, dl, pos - place AS start FROM qt JOIN pp USING (token) GROUP BY ALL HAVING count(*) = size) GROUP BY ALL),
df AS (SELECT query_id, phrase, count(*) AS df FROM f GROUP BY ALL), n AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM pw),
s AS (SELECT query_id, passage_id, wants, count(*) AS n_phrases, round(sum(greatest(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 1e-6::DOUBLE) * hits * 2.2::DOUBLE
  / (hits + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM f JOIN df USING (query_id, phrase), n GROUP BY ALL)
SELECT query_id, passage_id, score, n_phrases, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM s WHERE n_phrases >= wants QUALIFY rank <= {k}"""


def _asked(spark: SparkSession, sf_dir: str, text_of) -> DataFrame:
    w = postings.words(F.col("query"))
    return items(spark, sf_dir).select("query_id", text_of(w).alias("query"))


@query(_search_sql("[w[3:6], w[9:10]]", "count(*) OVER (PARTITION BY query_id)"))
def r05_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two phrases of each item, four words and two, both asked for."""
    quoted_ = lambda x: F.concat(F.lit('"'), F.array_join(x, " "), F.lit('"'))
    return postings.search(_asked(spark, sf_dir, lambda w: F.concat_ws(" ", quoted_(F.slice(w, 3, 4)), quoted_(F.slice(w, 9, 2)))), passages(spark, sf_dir), 10)


@query(_search_sql("list_transform(w[1:8], lambda x: [x])", "count(*) OVER (PARTITION BY query_id)"))
def r05_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight words of each item, all of them."""
    return postings.search(_asked(spark, sf_dir, lambda w: F.array_join(F.slice(w, 1, 8), " ")), passages(spark, sf_dir), 10)


@query(_search_sql("list_concat([w[3:4]], list_transform(w[6:9], lambda x: [x]))", "1"))
def r05_any_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase of two words or any of four words of each item."""
    said = lambda w: F.concat(F.lit('"'), F.array_join(F.slice(w, 3, 2), " "), F.lit('" OR '), F.array_join(F.slice(w, 6, 4), " OR "))
    return postings.search(_asked(spark, sf_dir, said), passages(spark, sf_dir), 10)


@query("SELECT doc_id AS passage_id, source FROM documents d WHERE lang IN ('en', 'fr') AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def r06_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("passage_id"))
    return retrieve.eligible(passages(spark, sf_dir, "lang", "source"), flagged, ["en", "fr"]).select("passage_id", "source")


@query(f"""WITH {_PAIRS}, lx AS (SELECT query_id, passage_id, row_number() OVER (PARTITION BY query_id ORDER BY overlap / sqrt(greatest(1, n_terms)) DESC, passage_id) AS rank FROM pairs QUALIFY rank <= 40), {_BM25.format(k=40)},
u AS (SELECT query_id, passage_id, 1.0::DOUBLE / (60 + rank) AS part FROM lx UNION ALL SELECT query_id, passage_id, 1.0::DOUBLE / (60 + rank) FROM bm), f AS (SELECT query_id, passage_id, round(sum(part), 9) AS score, count(*) AS n_channels FROM u GROUP BY ALL)
SELECT query_id, passage_id, score, n_channels, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM f QUALIFY rank <= 6""")
def r07_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, p = items(spark, sf_dir), passages(spark, sf_dir)
    return retrieve.fused([retrieve.lexical(q, p, 40), retrieve.full_text(q, p, 40)], k=6)


_FACETS = r"""SELECT item_id AS query_id, list_position(fs, f) AS facet_no, f AS facet FROM (SELECT item_id, fs, unnest(fs) AS f FROM (SELECT item_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:4] AS fs FROM
(SELECT item_id, list_filter(list_transform(string_split(text, '.'), lambda x: trim(regexp_replace(x, '[\s\p{Z}\x{85}\x{0B}]+', ' ', 'g'))), lambda x: x <> '' AND x <> text) AS l FROM benchmark)))"""


@query(_FACETS)
def r08_r10_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    fs = F.slice(F.array_distinct(F.filter(F.transform(F.split("query", r"\."), text.collapsed), lambda x: (x != "") & (x != F.col("query")))), 1, 4)
    return items(spark, sf_dir).select("query_id", F.posexplode(fs).alias("i", "facet")).select("query_id", (F.col("i") + 1).alias("facet_no"), "facet")


_RRF = f"""{_PAIRS}, lx AS (SELECT query_id, passage_id, row_number() OVER (PARTITION BY query_id ORDER BY overlap / sqrt(greatest(1, n_terms)) DESC, passage_id) AS rank FROM pairs QUALIFY rank <= 40), {_BM25.format(k=40)},
u AS (SELECT query_id, passage_id, 1.0::DOUBLE / (60 + rank) AS part FROM lx UNION ALL SELECT query_id, passage_id, 1.0::DOUBLE / (60 + rank) FROM bm), f AS (SELECT query_id, passage_id, round(sum(part), 9) AS score FROM u GROUP BY ALL),
m AS (SELECT query_id, passage_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM f QUALIFY rank <= 6)""".replace("FROM benchmark", "FROM asked")


@query(f"""WITH facets AS ({_FACETS}), asked AS (SELECT item_id * 5 AS item_id, text FROM benchmark UNION ALL SELECT query_id * 5 + facet_no, facet FROM facets), {_RRF}
SELECT query_id // 5 AS query_id, passage_id, min(rank)::INT AS rank, count_if(query_id % 5 > 0)::BIGINT AS n_facets FROM m WHERE query_id % 5 = 0 OR rank <= 2 GROUP BY ALL""")
def r08_reserved_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, p = items(spark, sf_dir), passages(spark, sf_dir)
    asked = q.select((F.col("query_id") * 5).alias("query_id"), "query")
    asked = asked.unionByName(r08_r10_facets(spark, sf_dir).select((F.col("query_id") * 5 + F.col("facet_no")).alias("query_id"), F.col("facet").alias("query")))
    ranked = retrieve.fused([retrieve.lexical(asked, p, 40), retrieve.full_text(asked, p, 40)], k=6)
    ranked = ranked.select(F.expr("query_id div 5").alias("query_id"), F.expr("query_id % 5").alias("facet_no"), "passage_id", "rank")
    return retrieve.reserved(ranked)


@query("SELECT item_id, concat_ws(chr(10), nullif(regexp_extract(text, '^(\\S+)', 1), ''), text, CASE WHEN item_id % 2 = 0 THEN 'help' END) AS composed FROM benchmark")
def r13_compose_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.concat_ws("\n", F.nullif(F.regexp_extract("text", r"^(\S+)", 1), F.lit("")), "text", F.when(F.col("item_id") % 2 == 0, "help")).alias("composed"))


@query(f"""WITH {_PAIRS}, f AS (SELECT query_id, passage_id, overlap / sqrt(greatest(1, n_terms)) AS score, lang FROM pairs), p1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, passage_id) AS rank FROM f QUALIFY rank <= 4),
c AS (SELECT query_id, lang AS concept FROM p1 WHERE rank = 1), s2 AS (SELECT f.query_id, passage_id, score * CASE WHEN lang = concept THEN 2.0 ELSE 1.0 END AS score FROM f JOIN c ON f.query_id = c.query_id)
SELECT query_id, passage_id, round(score, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s2.score DESC, passage_id) AS rank FROM s2 QUALIFY rank <= 4""")
def r14_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.two_pass(items(spark, sf_dir), passages(spark, sf_dir, "lang"), "lang")


_RANKED = _lexical_sql("overlap / sqrt(greatest(1, n_terms))", 40, "query_id, passage_id, source AS file, n_chars, round(score, 9) AS score, rank")


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, p = items(spark, sf_dir), passages(spark, sf_dir, "source", "n_chars")
    files = p.select("passage_id", F.col("source").alias("file"), "n_chars")
    terms = F.size(text.lexical_terms(F.col("body")))
    exact = retrieve.lexical(q, p.select("passage_id", "body"), 40).join(files, "passage_id").join(p.select("passage_id", terms.alias("n_terms")), "passage_id")
    return exact.withColumn("score", F.round(F.col("overlap") / F.sqrt(F.greatest(F.lit(1), "n_terms")), 9)).select("query_id", "passage_id", "file", "n_chars", "score", "rank")


@query(f"""WITH RECURSIVE ranked AS ({_RANKED}), g AS (
  SELECT query_id, rank, passage_id, n_chars, n_chars <= 12000 AS kept, CASE WHEN n_chars <= 12000 THEN n_chars ELSE 0 END AS used FROM ranked WHERE rank = 1
  UNION ALL SELECT r.query_id, r.rank, r.passage_id, r.n_chars, g.used + r.n_chars <= 12000, g.used + CASE WHEN g.used + r.n_chars <= 12000 THEN r.n_chars ELSE 0 END FROM g JOIN ranked r ON r.query_id = g.query_id AND r.rank = g.rank + 1)
SELECT query_id, rank::INT AS rank, passage_id, n_chars, kept FROM g""")
def w12_context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.context_budget(_ranked(spark, sf_dir))


@query(f"""WITH ranked AS ({_RANKED}), n AS (SELECT *, row_number() OVER (PARTITION BY query_id, file ORDER BY score DESC, passage_id) AS nth FROM ranked),
s AS (SELECT query_id, passage_id, file, nth, round(score * power(0.95::DOUBLE, greatest(0, nth - 4)), 9) AS score FROM n)
SELECT query_id, passage_id, file, nth, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s.score DESC, passage_id) AS rank FROM s QUALIFY rank <= 10""")
def w13_soft_file_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieve.soft_file_limit(_ranked(spark, sf_dir), 10).select("query_id", "passage_id", "file", "nth", F.round("score", 6).alias("score"), "rank")


@query("SELECT o_orderkey AS id, o_custkey AS custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 3")
def w02_top_k_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return retrieve.top(o, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("custkey"), "rank")


@query(f"""WITH {_PAIRS}, s AS (SELECT query_id, passage_id, round(overlap / sqrt(greatest(1, n_terms)), 4) AS score, CASE WHEN lang = 'en' AND n_chars < 400 THEN 0 WHEN lang = 'en' THEN 1 ELSE 2 END AS tier FROM pairs)
SELECT query_id, passage_id, score, tier, row_number() OVER (PARTITION BY query_id ORDER BY tier, score DESC, passage_id) AS rank FROM s QUALIFY rank <= 8""")
def z21_widened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short English passages first; what is missing comes from all English ones, then from every language."""
    english = F.col("lang") == "en"
    found = retrieve.widened(items(spark, sf_dir), passages(spark, sf_dir, "lang", "n_chars"), [english & (F.col("n_chars") < 400), english, F.lit(True)], 8, retrieve.lexical)
    return found.select("query_id", "passage_id", "score", "tier", "rank")
