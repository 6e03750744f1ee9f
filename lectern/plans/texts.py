"""Queries over the scalar text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, text
from .base import query, quoted, table

#: Unicode white space for RE2, which reads \s as ASCII.
SPACE = r"[\s\p{Z}\x{85}\x{0B}]+"
LINES = rf"list_filter(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '{SPACE}', ' ', 'g'))), lambda x: x <> '')"
LEXICAL = f"list_distinct(list_filter(regexp_extract_all(lower({{}}), '[a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN ({quoted(fixed.LEXICAL_STOP)})))"


def stem_sql(t: str = "t") -> str:
    cases = " ".join(f"WHEN ends_with({t}, '{s}') AND length({t}) > {len(s) + 3} THEN {t}[:length({t}) - {len(s)}]" + (" || 'y'" if s == "ies" else "") for s in fixed.SUFFIXES)
    return f"CASE {cases} ELSE {t} END"


def evidence_sql(x: str) -> str:
    return rf"list_transform(list_filter(regexp_extract_all(lower(regexp_replace({x}, '\\[a-zA-Z]+', ' ', 'g')), '[a-z][a-z0-9]*|\d+'), lambda t: length(t) >= 2 AND t NOT IN ({quoted(fixed.EVIDENCE_STOP)})), lambda t: {stem_sql()})"


def link_sql(x: str) -> str:
    return f"list_distinct(list_filter({evidence_sql(x)}, lambda t: NOT regexp_matches(t, '^[0-9]+$') AND length(t) >= 3 AND t NOT IN ({quoted(fixed.LINK_STOP)})))"


@query(rf"SELECT doc_id, len({LINES})::BIGINT AS n_lines, md5(array_to_string({LINES}, chr(10))) AS lines_md5 FROM documents")
def t01_normalize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ls = text.lines(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(ls).cast("long").alias("n_lines"), F.md5(F.array_join(ls, "\n").cast("binary")).alias("lines_md5"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(array_to_string(list_transform(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, '[\s\p{Z}\x{85}\x{0B}]+$', '')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), chr(10))) AS intake_md5 FROM documents")
def t02_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.intake(F.col("text")).cast("binary")).alias("intake_md5"))


@query("SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM customer")
def t03_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.slug(F.col("c_name")).alias("slug"))


@query(f"SELECT doc_id, len({LEXICAL.format('text')})::BIGINT AS n_terms, md5(array_to_string(list_sort({LEXICAL.format('text')}), ' ')) AS terms_md5 FROM documents")
def t04_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = text.lexical_terms(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(ts).cast("long").alias("n_terms"), F.md5(F.array_join(F.array_sort(ts), " ").cast("binary")).alias("terms_md5"))


@query(f"SELECT doc_id, len({evidence_sql('text')})::BIGINT AS n_terms, md5(array_to_string({evidence_sql('text')}, ' ')) AS terms_md5 FROM documents")
def t05_stem_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = text.evidence_terms(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(ts).cast("long").alias("n_terms"), F.md5(F.array_join(ts, " ").cast("binary")).alias("terms_md5"))


@query(f"SELECT t AS word, {stem_sql()} AS stem FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS t FROM conversations)")
def t06_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", text.stem(F.col("word")).alias("stem"))


@query(f"SELECT conv_id, turn, array_to_string(list_sort({link_sql('text')}), ' ') AS terms FROM conversations")
def t07_link_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(text.link_terms(F.col("text"))), " ").alias("terms"))


@query(r"SELECT item_id, trim(regexp_extract(split_part(text, ':', 1), '^(.*?)(?:\s\(|\sas\s|\s=\s|$)', 1, 's')) AS head FROM benchmark")
def t08_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", text.head(F.col("text")).alias("head"))


@query(rf"SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: t <> 'or' AND t NOT IN ({quoted(fixed.FULL_TEXT_STOP)})))), ' ') AS terms, CASE WHEN regexp_matches(text, '\s+OR\s+') THEN 'OR' ELSE 'AND' END AS mode FROM benchmark")
def t09_websearch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(text.full_text_terms(F.col("text"))), " ").alias("terms"), text.full_text_mode(F.col("text")).alias("mode"))


#: Formulas with the document's number in them, as the tables hold none.
_FORMULAS = ("'∫ x² dx = \\frac{' || doc_id || '}{2} − √π · θ'", "'\\left( a_' || doc_id || ' ≤ b \\right) × 3³'", "'limit of terms ' || doc_id")
_PLAIN = r"replace(regexp_replace(lower(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(translate({0}, '−–′·×⋅', '--''***'), '∫', 'int'), '²', '^2'), '³', '^3'), '√', 'sqrt'), 'π', 'pi'), 'θ', 'theta'), '∞', 'infty'), '≤', '<='), '≥', '>='), '\\(left|right|displaystyle|,|;|!|quad)', '', 'g'), '\\([a-zA-Z]+)', '\1', 'g')), '[\s{{}}$]', '', 'g'), '\', '')"


@query("SELECT doc_id, formula, " + _PLAIN.format("formula") + r" AS plain, regexp_matches(formula, '[=^''/+*∫√]|\\[a-zA-Z]+|\d|[a-z]\(|−|-\s*\w') AS is_formula FROM (" + " UNION ALL ".join(f"SELECT doc_id, {f} AS formula FROM documents" for f in _FORMULAS) + ")")
def t10_t11_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    exprs = F.array(*[F.expr(f.replace("\\", "\\\\")) for f in _FORMULAS])
    rows = docs.select("doc_id", F.explode(exprs).alias("formula"))
    return rows.select("doc_id", "formula", text.plain_math(F.col("formula")).alias("plain"), text.is_formula(F.col("formula")).alias("is_formula"))


_HEADER = "'EN.' || lpad((doc_id % 900 + 100)::VARCHAR, 3, '0') || '.' || lpad((doc_id % 7 + 100)::VARCHAR, 3, '0') || ' Advanced ' || source || ' Fall 20' || lpad((doc_id % 30 + 10)::VARCHAR, 2, '0')"


@query(rf"SELECT doc_id, regexp_extract(h, '(?i)\b(?:[a-z]{{2}}[.\s-]?)?\d{{3}}[.]\d{{3}}\b') AS number, regexp_extract(h, '(?i)\b(?:fall|summer|winter|spring|fa|su|wi|sp|f|s|w)\s+20\d{{2}}\b') AS term, regexp_replace(lower(regexp_extract(h, '(?i)\b(?:[a-z]{{2}}[.\s-]?)?\d{{3}}[.]\d{{3}}\b')), '[^a-z0-9]', '', 'g') AS canonical, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(h), '[a-z][a-z0-9]+'), lambda t: t NOT IN ({quoted(fixed.IDENTITY_STOP)})))), ' ') AS tokens FROM (SELECT doc_id, {_HEADER} AS h FROM documents)")
def t12_t16_course_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda m, a, w: F.lpad((F.col("doc_id") % m + a).cast("string"), w, "0")
    h = F.concat(F.lit("EN."), n(900, 100, 3), F.lit("."), n(7, 100, 3), F.lit(" Advanced "), F.col("source"), F.lit(" Fall 20"), n(30, 10, 2))
    rows = table(spark, sf_dir, "documents").select("doc_id", h.alias("h"))
    number = text.course_number(F.col("h"))
    return rows.select("doc_id", number.alias("number"), text.term_name(F.col("h")).alias("term"), text.canonical_number(number).alias("canonical"), F.array_join(F.array_sort(text.identity_tokens(F.col("h"))), " ").alias("tokens"))


@query("""SELECT doc_id, CASE WHEN n_chars > 30000 THEN 'textbook'
  WHEN contains(source, 'syllabus') OR (contains(b, 'syllabus')::INT + contains(b, 'course description')::INT + contains(b, 'grading')::INT + contains(b, 'office hours')::INT) >= 2 THEN 'syllabus'
  WHEN contains(source, 'note') OR contains(source, 'lecture') OR contains(source, 'chapter') OR contains(b, 'lecture') OR contains(b, 'chapter') OR contains(b, 'theorem') OR contains(b, 'example') OR contains(b, 'definition') THEN 'lecture_notes'
  ELSE 'other' END AS document_type FROM (SELECT doc_id, source, n_chars, lower(text) AS b FROM documents)""")
def t17_classify_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = F.floor(F.col("n_chars") / 30001 * 301)
    return table(spark, sf_dir, "documents").select("doc_id", text.document_type(F.col("source"), F.lower("text"), F.when(F.col("n_chars") > 30000, 301).otherwise(F.least(pages, F.lit(300)))).alias("document_type"))


@query("""SELECT page_id, CASE WHEN contains(l, 'syllabus') THEN 'syllabus' WHEN regexp_matches(l, 'note|lecture|chapter') THEN 'lecture_notes' WHEN regexp_matches(l, 'textbook|book') THEN 'textbook' ELSE 'other' END AS file_type FROM (SELECT page_id, lower(url) AS l FROM pages)""")
def t18_classify_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.file_type(F.col("url")).alias("file_type"))


@query(r"""WITH u AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations),
w AS (SELECT conv_id, turn, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS q, string_split(lower(trim(regexp_replace(before, '\s+', ' ', 'g'))), ' ') AS ws FROM u WHERE before IS NOT NULL)
SELECT conv_id, turn, len(list_filter(range(1, greatest(1, len(ws) - 4)), lambda i: contains(q, array_to_string(ws[i:i + 5], ' ')))) > 0 AS copied FROM w""")
def t28_shingle_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.expr("lag(text) OVER (PARTITION BY conv_id ORDER BY turn)")
    rows = table(spark, sf_dir, "conversations").withColumn("before", before).where("before IS NOT NULL")
    return rows.select("conv_id", "turn", text.copies_text(F.col("text"), F.col("before")).alias("copied"))


_CITED = "text || ' [P' || (turn % 3 + 1) || '] and [P2, P' || (conv_id % 5 + 1) || '] (see [P1]) .'"


@query(rf"SELECT conv_id, turn, array_to_string(list_filter(ls, lambda x, i: list_position(ls, x) = i), ' ') AS labels FROM (SELECT conv_id, turn, flatten(list_transform(regexp_extract_all({_CITED}, '\[(P\d+(?:\s*,\s*P\d+)*)\]', 1), lambda g: string_split(replace(g, ' ', ''), ','))) AS ls FROM conversations)")
def t29_citation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.citation_labels(F.expr(_CITED)), " ").alias("labels"))


@query("SELECT conv_id, turn, trim(regexp_replace(text, '[ \t]{2,}', ' ', 'g')) || ' holds [P1, P2].' AS tidy FROM conversations WHERE NOT regexp_matches(text, '[\\[\\](),;:!?.]')")
def t30_strip_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where(~F.col("text").rlike(r"[\[\](),;:!?.]"))
    return rows.select("conv_id", "turn", text.without_labels(F.concat(F.col("text"), F.lit(" holds [P1, P9, P2][P7].")), F.array(F.lit("P9"), F.lit("P7"))).alias("tidy"))


@query("SELECT doc_id, CASE WHEN length(text) > 360 THEN rtrim(text[:359]) || '…' ELSE text END AS bounded FROM documents")
def t31_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.bounded(F.col("text")).alias("bounded"))


@query("SELECT p_partkey, regexp_replace(list_extract(string_split('calc1.' || (p_partkey % 9) || '.' || replace(p_name, ' ', '-'), '.'), -1), '[-_]+', ' ', 'g') AS label FROM part")
def t32_concept_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    cid = F.concat(F.lit("calc1."), (F.col("p_partkey") % 9).cast("string"), F.lit("."), F.replace("p_name", F.lit(" "), F.lit("-")))
    return table(spark, sf_dir, "part").select("p_partkey", text.concept_label(cid).alias("label"))


@query(r"SELECT doc_id, regexp_matches(b, '[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]') AS cjk, CASE WHEN regexp_matches(b, '[\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]') OR lang <> 'en' THEN 'query_language_unsupported' END AS warning FROM (SELECT doc_id, lang, text || CASE WHEN doc_id % 7 = 0 THEN ' 微分' ELSE '' END AS b FROM documents)")
def t33_language_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.concat(F.col("text"), F.when(F.col("doc_id") % 7 == 0, " 微分").otherwise(""))
    cjk = text.has_cjk(b)
    return table(spark, sf_dir, "documents").select("doc_id", cjk.alias("cjk"), F.when(cjk | (F.col("lang") != "en"), "query_language_unsupported").alias("warning"))


@query(rf"SELECT doc_id, md5(trim(regexp_replace(text, '{SPACE}', ' ', 'g'))) AS collapsed_md5 FROM documents")
def t34_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.collapsed(F.col("text")).cast("binary")).alias("collapsed_md5"))


@query("SELECT doc_id, '/courses/' || source || '/' || doc_id || '?page=1&lines=2-' || (doc_id % 9 + 2) AS url, 'psg_' || sha256(doc_id || '|v1|' || CASE WHEN doc_id % 3 = 0 THEN 'None' ELSE '1' END || '|2|' || (doc_id % 9 + 2))[:16] AS passage_id FROM documents")
def t35_highlight_and_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    page, last = F.when(F.col("doc_id") % 3 != 0, F.lit(1)), F.col("doc_id") % 9 + 2
    url = text.highlight_url(F.concat(F.lit("/courses/"), "source"), F.col("doc_id"), F.lit(1), F.lit(2), last)
    return docs.select("doc_id", url.alias("url"), text.passage_id(F.col("doc_id"), F.lit("v1"), page, F.lit(2), last).alias("passage_id"))


@query("SELECT event_id, round((event_id % 900 * 0.042 + CASE WHEN event_type = 'error' THEN NULL ELSE event_id % 70 END * 0.168) / 1000000, 8) AS cost FROM events")
def t36_token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.when(F.col("event_type") != "error", F.col("event_id") % 70)
    return table(spark, sf_dir, "events").select("event_id", text.token_cost(F.col("event_id") % 900, out, F.lit(0.042), F.lit(0.168)).alias("cost"))


_SAID = "'Step ' || turn || ': y = x^' || (conv_id % 5 + 2) || '/2 + C' || chr(10) || CASE turn % 3 WHEN 0 THEN 'or $\\frac{x}{3}\\cdot\\sin(2x)$' WHEN 1 THEN 'the answer is xsin(x)+cos(x).' ELSE 'try 3x^2 + 2x' END"


def _offered_sql(text: str) -> str:
    """Candidates in SQL: RE2 has no look-around, and none is needed."""
    out = "trim(x)"
    for pattern, by in fixed.NOTATION:
        by = by.replace("$1", r"\1").replace("$2", r"\2")
        out = f"regexp_replace({out}, '{pattern}', '{by}', 'g')"
    found = [f"list_transform(string_split({text}, '=')[2:], lambda x: string_split(regexp_replace(x, '{fixed.OFFER_ENDS}', chr(10), 'g'), chr(10))[1])"]
    found += [f"regexp_extract_all({text}, '{pattern}', {group})" for pattern, group in fixed.OFFERED]
    listed = f"list_filter(list_transform(flatten([{', '.join(found)}]), lambda x: trim({out})), lambda x: x <> '')"
    return f"list_filter({listed}, lambda x, i: list_position({listed}, x) = i)"


@query(f"SELECT conv_id, turn, array_to_string({_offered_sql('said')}, ' | ') AS candidates FROM (SELECT conv_id, turn, {_SAID} AS said FROM conversations)")
def t25_t26_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that a turn of a conversation might offer, as operators and calls."""
    kinds = F.when(F.col("turn") % 3 == 0, r"or $\frac{x}{3}\cdot\sin(2x)$").when(F.col("turn") % 3 == 1, "the answer is xsin(x)+cos(x).").otherwise("try 3x^2 + 2x")
    said = F.concat(F.lit("Step "), F.col("turn").cast("string"), F.lit(": y = x^"), (F.col("conv_id") % 5 + 2).cast("string"), F.lit("/2 + C\n"), kinds)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(text.math_candidates(said), " | ").alias("candidates"))


@query("""SELECT doc_id, coalesce(kind = 'explanation' AND (starts_with(heading, 'Chapter') OR heading LIKE '%.2 Series' AND len(string_split(trim(body), chr(10))) <= 2), false) AS is_heading FROM (SELECT doc_id,
CASE WHEN doc_id % 4 = 0 THEN 'theorem' ELSE 'explanation' END AS kind, CASE doc_id % 3 WHEN 0 THEN 'Chapter ' || (doc_id % 9 + 1) || ': Limits' WHEN 1 THEN (doc_id % 9 + 1) || '.2 Series' END AS heading, text AS body FROM documents)""")
def t22_structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that are the heading of a chapter or, if short, of a section."""
    n = F.col("doc_id")
    number = (n % 9 + 1).cast("string")
    heading = F.when(n % 3 == 0, F.concat(F.lit("Chapter "), number, F.lit(": Limits"))).when(n % 3 == 1, F.concat(number, F.lit(".2 Series")))
    kind = F.when(n % 4 == 0, "theorem").otherwise("explanation")
    return table(spark, sf_dir, "documents").select("doc_id", text.structural(kind, heading, F.col("text")).alias("is_heading"))
