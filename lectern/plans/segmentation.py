"""Queries of segmentation: documents as one page each, with headings and keywords put in where the tables have none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text
from ..operators import segment
from .base import query, quoted, table
from .texts import LINES, SPACE

#: Lines put before every third, fifth and seventh line, so that chapters, sections and typed blocks occur.
_MARKED = """CASE WHEN (doc_id + line_no) % 11 = 0 THEN 'Chapter ' || line_no || ': ' || text WHEN (doc_id + line_no) % 7 = 0 THEN '3.' || line_no || ' ' || text
 WHEN (doc_id + line_no) % 5 = 0 THEN 'Definition: ' || text WHEN (doc_id + line_no) % 13 = 0 THEN 'Example. ' || text ELSE text END"""
_ROWS = f"l0 AS (SELECT doc_id, unnest({LINES}) AS text, unnest(range(1, len({LINES}) + 1)) AS line_no FROM documents), l AS (SELECT doc_id, line_no, {_MARKED} AS text FROM l0)"
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{k}'" for p, k in fixed.BLOCK_OPENINGS) + " END"
_CLASSED = rf"""c0 AS (SELECT *, nullif(regexp_extract(text, '{fixed.CHAPTER}', 1), '') AS ch, {_KIND} AS kind FROM l),
c AS (SELECT *, CASE WHEN ch IS NULL THEN nullif(regexp_extract(text, '{fixed.SECTION}', 1), '') END AS se FROM c0),
t0 AS (SELECT *, coalesce(ch, se, kind) IS NOT NULL AS opens, last_value(ch IGNORE NULLS) OVER w AS chapter, count(ch) OVER w AS chs, count(coalesce(ch, se)) OVER w AS epoch FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
t AS (SELECT *, last_value(se IGNORE NULLS) OVER (PARTITION BY doc_id, chs ORDER BY line_no) AS section, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY line_no)::BIGINT AS run FROM t0)"""


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), F.col("text").alias("body"))
    return segment.lines(docs).withColumn("text", F.expr(_MARKED.replace("doc_id", "document_id")))


def tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.tracked(segment.classified(marked(spark, sf_dir)))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.blocks(tracked(spark, sf_dir))


@query(f"WITH {_ROWS}, {_CLASSED} SELECT doc_id AS document_id, line_no::INT AS line_no, kind, chapter, section, opens, epoch FROM t")
def g01_g02_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracked(spark, sf_dir).select("document_id", "line_no", "kind", "chapter", "section", "opens", "epoch")


_PARTS = """RECURSIVE_PARTS AS (
  SELECT doc_id, run, line_no, 0 AS part, length(text) AS held FROM n WHERE nth = 1
  UNION ALL SELECT n.doc_id, n.run, n.line_no, p.part + (p.held > 1400)::INT, CASE WHEN p.held > 1400 THEN 0 ELSE p.held END + length(n.text)
  FROM RECURSIVE_PARTS p JOIN n ON n.doc_id = p.doc_id AND n.run = p.run AND n.line_no = p.line_no + 1 )"""
_BLOCKS = f"""WITH RECURSIVE {_ROWS}, {_CLASSED}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY line_no) AS nth FROM t), {_PARTS},
b AS (SELECT t.doc_id, t.run, p.part, min(t.line_no) AS line_start, max(t.line_no) AS line_end, min_by(chapter, t.line_no) AS chapter_id, min_by(section, t.line_no) AS section_id, min_by(epoch, t.line_no) AS epoch,
  min_by(CASE WHEN opens AND part = 0 THEN kind END, t.line_no) AS k, min_by(CASE WHEN opens AND part = 0 THEN text END, t.line_no) AS heading, bool_or(opens AND part = 0) AS o, string_agg(text, chr(10) ORDER BY t.line_no) AS body,
  first(kind ORDER BY t.line_no) AS k1, first(opens ORDER BY t.line_no) AS o1, first(text ORDER BY t.line_no) AS h1, first(chapter ORDER BY t.line_no) AS c1, first(section ORDER BY t.line_no) AS s1
  FROM t JOIN RECURSIVE_PARTS p ON t.doc_id = p.doc_id AND t.run = p.run AND t.line_no = p.line_no GROUP BY ALL)
"""


@query(_BLOCKS + """SELECT doc_id AS document_id, line_start::INT AS line_start, line_end::INT AS line_end, c1 AS chapter_id, s1 AS section_id, CASE WHEN o1 AND part = 0 THEN coalesce(k1, 'explanation') ELSE 'explanation' END AS block_type,
  CASE WHEN o1 AND part = 0 THEN h1 END AS heading, row_number() OVER (PARTITION BY doc_id, epoch ORDER BY line_start) AS block_no, md5(body) AS body_md5 FROM b""")
def g03_g05_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("document_id", "line_start", "line_end", "chapter_id", "section_id", "block_type", "heading", "block_no", F.md5(F.col("text").cast("binary")).alias("body_md5"))


_CONCEPTS = [("c.de", "de"), ("c.the", "the"), ("c.ein", "ein"), ("c.of-the", "of the")]
_TAGS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(concat_ws(' ', heading, text), '(?i)\\b{n.replace(' ', '[\\s\\-]+')}\\b') THEN '{c}' END" for c, n in _CONCEPTS) + "], lambda x: x IS NOT NULL)"
_BLOCK_TEXT = _BLOCKS + ", bt AS (SELECT doc_id, line_start, line_end, c1 AS chapter_id, s1 AS section_id, CASE WHEN o1 AND part = 0 THEN h1 END AS heading, regexp_replace(body, '[^\\x00-\\x7f]', 'x', 'g') AS text FROM b)"


def _ascii_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word borders beside accented letters differ between engines; both see ASCII."""
    ascii_ = lambda c: F.regexp_replace(c, r"[^\x00-\x7f]", "x")
    return blocks(spark, sf_dir).withColumn("text", ascii_("text")).withColumn("heading", ascii_("heading"))


_TAGGED = _BLOCK_TEXT + ", bt2 AS (SELECT * REPLACE (regexp_replace(heading, '[^\\x00-\\x7f]', 'x', 'g') AS heading) FROM bt), tg AS (SELECT *, " + _TAGS + " AS ids FROM bt2)"


@query(_TAGGED + " SELECT doc_id AS document_id, line_start::INT AS line_start, array_to_string(ids, ' ') AS concepts FROM tg")
def j06_concept_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.tagged(_ascii_blocks(spark, sf_dir), _CONCEPTS).select("document_id", "line_start", F.array_join("concept_ids", " ").alias("concepts"))


_VOCABULARY = "SELECT DISTINCT array_to_string(w[2:3], ' ') AS name FROM (SELECT regexp_extract_all(lower(regexp_replace(text, '[^\\x00-\\x7f]', 'x', 'g')), '[a-z]+') AS w FROM documents) WHERE len(w) > 2"


@query(f"""WITH v AS ({_VOCABULARY}), d AS (SELECT doc_id, regexp_extract_all(regexp_replace(lower(regexp_replace(text, '[^\\x00-\\x7f]', 'x', 'g')), '[\\s\\-]+', ' ', 'g'), '\\w+|\\W') AS p FROM documents),
g AS (SELECT DISTINCT doc_id, p[i] || p[i + 1] || p[i + 2] AS name FROM (SELECT doc_id, p, unnest(range(1, len(p) - 1)) AS i FROM d)),
t AS (SELECT doc_id, string_agg(name, ';' ORDER BY name) AS concepts, count(*) AS n FROM g JOIN v USING (name) GROUP BY 1)
SELECT documents.doc_id, coalesce(n, 0) AS n, md5(coalesce(concepts, '')) AS concepts_md5 FROM documents LEFT JOIN t USING (doc_id)""")
def j06_large_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary that grows with the documents: two words of each of them, found in all of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(None).cast("string").alias("heading"), F.regexp_replace("text", r"[^\x00-\x7f]", "x").alias("text"))
    # the first three words, by possessive quantifiers: no more of a text is read, and none of it twice
    second = F.regexp_replace(F.regexp_extract(F.lower("text"), "^[^a-z]*+[a-z]++[^a-z]++([a-z]++[^a-z]++[a-z]++)", 1), "[^a-z]+", " ")
    names = docs.select(second.alias("name")).distinct()
    found = segment.tagged_by(docs, names.select(F.col("name").alias("concept_id"), "name", F.lit(0).alias("ordinal")), ["doc_id"])
    return found.select("doc_id", F.size("concept_ids").cast("long").alias("n"), F.md5(F.array_join("concept_ids", ";").cast("binary")).alias("concepts_md5"))


@query(_TAGGED + """, pl AS (SELECT doc_id, chapter_id, section_id, list_sort(list_distinct(flatten(list(ids)))) AS near FROM tg GROUP BY ALL)
SELECT tg.doc_id AS document_id, line_start::INT AS line_start, array_to_string(CASE WHEN len(ids) > 0 THEN ids ELSE near END, ' ') AS concepts FROM tg JOIN pl ON tg.doc_id = pl.doc_id AND tg.chapter_id IS NOT DISTINCT FROM pl.chapter_id AND tg.section_id IS NOT DISTINCT FROM pl.section_id""")
def j07_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = segment.propagated(segment.tagged(_ascii_blocks(spark, sf_dir), _CONCEPTS))
    return tagged.select("document_id", "line_start", F.array_join("concept_ids", " ").alias("concepts"))


@query(_TAGGED + """, k AS (SELECT * FROM tg WHERE coalesce(chapter_id, section_id) IS NOT NULL), a AS (SELECT doc_id, chapter_id, NULL::VARCHAR AS section_id, min(line_start) AS s, max(line_end) AS e, list_sort(list_distinct(flatten(list(ids)))) AS c FROM k GROUP BY doc_id, chapter_id
UNION ALL SELECT doc_id, chapter_id, section_id, min(line_start), max(line_end), list_sort(list_distinct(flatten(list(ids)))) FROM k WHERE section_id IS NOT NULL GROUP BY doc_id, chapter_id, section_id)
SELECT doc_id AS document_id, chapter_id, section_id, s::INT AS line_start, e::INT AS line_end, array_to_string(c, ' ') AS concepts FROM a""")
def g06_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = segment.sections(segment.tagged(_ascii_blocks(spark, sf_dir), _CONCEPTS))
    return out.select("document_id", "chapter_id", "section_id", "line_start", "line_end", F.array_join("concept_ids", " ").alias("concepts"))


@query(f"""WITH w AS (SELECT source, doc_id, unnest(ws) AS word, unnest(range(0, len(ws))) AS pos FROM (SELECT source, doc_id, regexp_extract_all(lower(text), '[a-z][a-z-]{{4,}}') AS ws FROM documents)),
c AS (SELECT source AS course, word, count(*) AS n, min((doc_id, pos)) AS f FROM w WHERE word NOT IN ({quoted(fixed.TOPIC_STOP)}) GROUP BY ALL) SELECT course, word, n, row_number() OVER (PARTITION BY course ORDER BY n DESC, f) AS rank FROM c QUALIFY rank <= 15""")
def g07_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.topics(table(spark, sf_dir, "documents").select(F.col("source").alias("course"), F.col("doc_id").alias("passage_id"), F.col("text").alias("body")), "course")


@query(_TAGGED + " SELECT doc_id AS document_id, count(*) AS n_blocks, count_if(len(ids) = 0)::BIGINT AS n_unmapped FROM tg GROUP BY 1")
def g08_unmapped_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = segment.tagged(_ascii_blocks(spark, sf_dir), _CONCEPTS)
    return tagged.groupBy("document_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.count_if(F.size("concept_ids") == 0).alias("n_unmapped"))


@query(f"SELECT doc_id, line_no::INT AS line_no, line_no BETWEEN 2 AND 2 + doc_id % 3 AS selected, md5(text) AS line_md5 FROM (SELECT doc_id, unnest({LINES}) AS text, unnest(range(1, len({LINES}) + 1)) AS line_no FROM documents)")
def k06_page_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), F.col("text").alias("body"))
    return segment.lines(docs).select(F.col("document_id").alias("doc_id"), "line_no", F.col("line_no").between(2, 2 + F.col("document_id") % 3).alias("selected"), F.md5(F.col("text").cast("binary")).alias("line_md5"))


__all__ = ["SPACE", "blocks", "marked", "text", "tracked"]
