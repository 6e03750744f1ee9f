"""Queries of record checks: parts as course records and sections, order lines as blocks, turns as submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.jsonschema import schema_errors
from ..operators import records
from .base import query, quoted, table


def _pick(xs: tuple, i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))


_KEYS = (*fixed.TOP_KEYS, *fixed.TOP_OPTIONAL, "Extra", "Another")


@query(f"""WITH k AS (SELECT p_partkey AS p, list_filter([{quoted(_KEYS)}], lambda x, i: (p_partkey * 7 + i * 3) % 5 <> 0) AS ks, ['1.0', '1.12', '2.0', '', '1.x'][p_partkey % 5 + 1] AS v FROM part)
SELECT p, array_to_string(list_concat(list_transform(list_filter([{quoted(fixed.TOP_KEYS)}], lambda x: NOT list_contains(ks, x)), lambda x: 'missing ' || x), list_transform(list_sort(list_filter(ks, lambda x: x NOT IN ({quoted((*fixed.TOP_KEYS, *fixed.TOP_OPTIONAL))}))), lambda x: 'unexpected ' || x), CASE WHEN trim(v) <> '' AND NOT regexp_matches(trim(v), '^1\\.\\d+$') THEN ['version'] ELSE [] END), '; ') AS errors FROM k""".replace("\\\\", "\\"))
def c01_top_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    keys = F.filter(F.array(*[F.lit(k) for k in _KEYS]), lambda x, i: (p * 7 + (i + 1) * 3) % 5 != 0)
    return table(spark, sf_dir, "part").select(p.alias("p"), F.array_join(records.top_level_errors(keys, _pick(("1.0", "1.12", "2.0", "", "1.x"), p % 5)), "; ").alias("errors"))


_FIELDS = ("id", "title", "level", "assumed_background", "module_ids", "course_id", "goal", "concept_ids", "module_id", "name", "summary", "prerequisite_ids", "difficulty_notes", "provenance", "colour")
_VALUES = ("text", "", "TBD", "[]", "[1]", None)
_REQUIRED = "CASE kind " + " ".join(f"WHEN '{k}' THEN [{quoted(v)}]" for k, v in fixed.RECORD_FIELDS.items()) + " END"
_HOLDS = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.MUST_HOLD.items()) + " END"


@query(f"""WITH r AS (SELECT p_partkey AS p, ['Course', 'Module', 'Concept'][p_partkey % 3 + 1] AS kind, p_partkey % 4 = 0 AS v11, list_filter([{quoted(_FIELDS)}], lambda x, i: (p_partkey + i * 5) % 4 <> 1) AS names FROM part),
f AS (SELECT *, {_REQUIRED} AS needed, {_HOLDS} AS holds, list_transform(names, lambda x: ['text', '', 'TBD', '[]', '[1]', NULL][(p + length(x)) % 6 + 1]) AS vals FROM r)
SELECT p, array_to_string(list_concat(list_transform(list_filter(needed, lambda x: NOT list_contains(names, x)), lambda x: 'V-02 missing ' || x), list_transform(list_sort(list_filter(names, lambda x: NOT list_contains(needed, x) AND x <> 'provenance')), lambda x: 'V-02 unknown ' || x), CASE WHEN list_contains(names, 'provenance') AND NOT v11 THEN ['V-02 provenance before 1.1'] ELSE [] END,
 list_transform(list_filter(needed, lambda x: list_contains(names, x) AND x NOT IN ({quoted(fixed.MAY_BE_EMPTY)}) AND CASE WHEN coalesce(x = holds, false) THEN coalesce(vals[list_position(names, x)], '[]') IN ('[]', '') ELSE coalesce(trim(vals[list_position(names, x)]) IN ('', 'TBD'), true) END), lambda x: 'V-08 ' || x)), '; ') AS errors FROM f""")
def c02_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    names = F.filter(F.array(*[F.lit(f) for f in _FIELDS]), lambda x, i: (p + (i + 1) * 5) % 4 != 1)
    fields = F.map_from_arrays(names, F.transform(names, lambda x: _pick(_VALUES, (p + F.char_length(x)) % 6)))
    return table(spark, sf_dir, "part").select(p.alias("p"), F.array_join(records.field_errors(_pick(tuple(fixed.RECORD_FIELDS), p % 3), fields, p % 4 == 0), "; ").alias("errors"))


@query(f"""WITH r AS (SELECT p_partkey AS p, ['LearningObjective', 'Source', 'Concept'][p_partkey % 3 + 1] AS kind, [{quoted((*fixed.BLOOM, *fixed.SOURCE_TYPES, "odd"))}][p_partkey * 5 % 12 + 1] AS v, p_partkey % 4 AS n FROM part)
SELECT p, array_to_string(list_concat(list_filter([CASE WHEN kind = 'LearningObjective' AND v NOT IN ({quoted(fixed.BLOOM)}) THEN 'bloom_level' END, CASE WHEN kind = 'Source' AND v NOT IN ({quoted(fixed.SOURCE_TYPES)}) THEN 'Source.type' END], lambda x: x IS NOT NULL), CASE WHEN kind = 'Concept' AND n IN (1, 3) THEN ['difficulty_notes'] ELSE [] END), '; ') AS errors FROM r""")
def c03_enums(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, words = F.col("p_partkey"), lambda *xs: F.array(*[F.lit(x) for x in xs])
    notes = F.when(p % 4 == 0, F.array(words("mitigation", "misconception"))).when(p % 4 == 1, F.array(words("misconception", "mitigation"), words("misconception"))).when(p % 4 == 3, F.array(words("misconception", "mitigation", "more")))
    return table(spark, sf_dir, "part").select(p.alias("p"), F.array_join(records.enum_errors(_pick(("LearningObjective", "Source", "Concept"), p % 3), _pick((*fixed.BLOOM, *fixed.SOURCE_TYPES, "odd"), p * 5 % 12), notes), "; ").alias("errors"))


@query("SELECT p_partkey AS p, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 5 = 0 THEN 'missing' WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN 'unknown' END AS error FROM part")
def c10_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(p.alias("p"), records.provenance_error(p % 2 == 0, p % 5 != 0, _pick(("guessed", "source_backed", "ai_inferred"), p % 3)).alias("error"))


_IFS = lambda *cs: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{w}' END" for t, w in cs) + "], lambda x: x IS NOT NULL), '; ')"


@query(f"""WITH r AS (SELECT p_partkey AS p, ['complete', 'partial', 'failed'][p_partkey % 3 + 1] AS st, p_partkey % 2 AS pages, p_partkey % 5 AS blocks, p_partkey % 4 AS warns, [{quoted(fixed.LABELLED)}][p_partkey % 8 + 1] AS kind, CASE WHEN p_partkey % 7 < 4 THEN p_partkey END AS fb, ['student_visible', 'engine_only'][p_partkey % 2 + 1] AS vis, ['none', 'rule', 'model'][p_partkey % 3 + 1] AS cs, ['supported', 'partial', 'no_support_found', 'failed'][p_partkey % 4 + 1] AS ret FROM part)
SELECT p, {_IFS(("st = 'failed' AND blocks > 0", "failed with blocks"), ("st = 'failed' AND warns < 1", "failed without a warning"), ("st <> 'failed' AND pages < 1", "no pages"), ("st <> 'failed' AND blocks < 1", "no blocks"), ("st = 'partial' AND warns < 1", "partial without a warning"))} AS record,
 {_IFS(("kind = 'solution' AND fb IS NULL", "solution for no block"), ("kind = 'solution' AND vis <> 'engine_only'", "solution is visible"), ("kind = 'proof' AND fb IS NULL", "proof of no block"), ("cs = 'none' AND blocks > 0", "concepts without a source"), ("cs <> 'none' AND blocks < 1", "no concepts"))} AS block,
 {_IFS(("ret IN ('supported', 'partial') AND blocks < 1", "no passages"), ("ret = 'partial' AND warns < 2", "partial, nothing uncovered"), ("ret IN ('no_support_found', 'failed') AND blocks > 0", "passages without support"), ("ret = 'failed' AND st <> 'failed'", "failed, but not said"))} AS bundle FROM r""")
def c22_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    status, blocks, warnings = _pick(("complete", "partial", "failed"), p % 3), p % 5, p % 4
    record = records.record_conditions(status, p % 2, blocks, warnings)
    block = records.block_conditions(_pick(fixed.LABELLED, p % 8), F.when(p % 7 < 4, p), _pick(("student_visible", "engine_only"), p % 2), _pick(("none", "rule", "model"), p % 3), blocks)
    bundle = records.bundle_conditions(_pick(("supported", "partial", "no_support_found", "failed"), p % 4), status, blocks, F.when(warnings >= 2, warnings))
    return table(spark, sf_dir, "part").select(p.alias("p"), *[F.array_join(x, "; ").alias(n) for x, n in ((record, "record"), (block, "block"), (bundle, "bundle"))])


RECORD_SCHEMA = {
    "type": "object",
    "required": ["document_id", "status", "lang", "blocks", "warnings"],
    "additionalProperties": False,
    "properties": {
        "document_id": {"type": "integer", "minimum": 0}, "status": {"enum": ["complete", "partial", "failed"]}, "lang": {"type": "string", "pattern": "^(en|fr|de)$"},
        "title": {"type": "string", "minLength": 4, "maxLength": 12}, "blocks": {"type": "array", "maxItems": 3, "items": {"$ref": "#/$defs/Block"}}, "warnings": {"type": "array", "items": {"type": "string"}},
    },
    "allOf": [
        {"if": {"properties": {"status": {"const": "failed"}}}, "then": {"properties": {"blocks": {"maxItems": 0}, "warnings": {"minItems": 1}}}, "else": {"properties": {"blocks": {"minItems": 1}}}},
        {"if": {"properties": {"status": {"const": "partial"}}}, "then": {"properties": {"warnings": {"minItems": 1}}}},
    ],
    "$defs": {
        "Block": {
            "type": "object", "required": ["type"], "properties": {"type": {"enum": ["text", "solution", "proof"]}},
            "if": {"properties": {"type": {"const": "solution"}}}, "then": {"required": ["for_block_id"], "properties": {"visibility": {"const": "engine_only"}}},
        }
    },
}
_BROKEN = (
    ("lang NOT IN ('en', 'fr', 'de')", "'$.lang: pattern'"), ("d % 11 = 3", "'$.title: minLength'"), ("d % 13 = 4 AND d % 11 <> 3", "'$.title: maxLength'"), ("d % 17 = 5", "'$.extra: additionalProperties'"),
    ("d % 19 = 6", "'$: required warnings'"), ("n > 3", "'$.blocks: maxItems'"), ("st = 'failed' AND n > 0", "'$.blocks: maxItems'"), ("st = 'failed' AND d % 2 = 0 AND d % 19 <> 6", "'$.warnings: minItems'"),
    ("st <> 'failed' AND n = 0", "'$.blocks: minItems'"), ("st = 'partial' AND d % 2 = 0 AND d % 19 <> 6", "'$.warnings: minItems'"),
)


@query(f"""WITH r AS (SELECT doc_id AS d, lang, ['complete', 'partial', 'failed'][doc_id % 3 + 1] AS st, n_chars % 5 AS n FROM documents)
SELECT d AS doc_id, coalesce(array_to_string(list_sort(list_concat([{", ".join(f"CASE WHEN {t} THEN {m} END" for t, m in _BROKEN)}],
  CASE WHEN n > 0 AND d % 5 = 0 THEN ['$.blocks[0]: required for_block_id'] ELSE [] END, CASE WHEN n > 0 AND d % 5 = 0 AND d % 2 = 0 THEN ['$.blocks[0].visibility: const'] ELSE [] END)), '; '), '') AS broken FROM r""")
def c22_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of documents as JSON against a compiled schema: references, conditions, bounds, unknown members."""
    d, n = F.col("doc_id"), F.col("n_chars") % 5
    first = F.when(d % 5 == 0, F.when(d % 2 == 0, '{"type":"solution","visibility":"open"}').otherwise('{"type":"solution"}')).otherwise('{"type":"text"}')
    blocks = F.concat(F.lit("["), F.when(n > 0, F.concat_ws(",", first, F.array_join(F.array_repeat(F.lit('{"type":"proof"}'), (n - 1).cast("int")), ","))).otherwise(""), F.lit("]"))
    blocks = F.regexp_replace(blocks, r",\]$", "]")
    title = F.when(d % 11 == 3, "abc").when(d % 13 == 4, "a title too long").otherwise("a title")
    warnings = F.when(d % 19 == 6, "").when(d % 2 == 0, ',"warnings":[]').otherwise(',"warnings":["w"]')
    said = F.concat(F.lit('{"document_id":'), d.cast("string"), F.lit(',"status":"'), _pick(("complete", "partial", "failed"), d % 3), F.lit('","lang":"'), "lang", F.lit('","title":"'), title, F.lit('","blocks":'), blocks, warnings, F.when(d % 17 == 5, ',"extra":1').otherwise(""), F.lit("}"))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(schema_errors(said, RECORD_SCHEMA), "; ").alias("broken"))


_LINKS = (("Course.module_ids", "Module", 3), ("Module.course_id", "Course", 5), ("Module.concept_ids", "Concept", 7), ("Concept.module_id", "Module", 11), ("Concept.prerequisite_ids", "Concept", 13))
_REFS = " UNION ALL ".join(f"SELECT p_partkey AS owner, '{link}' AS link, '{kind}' AS kind, p_partkey * {m} % 400 AS target FROM part" for link, kind, m in _LINKS)


@query(f"SELECT owner, link, kind, target FROM ({_REFS}) r WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = target AND ['Course', 'Module', 'Concept'][p_partkey % 3 + 1] = kind)")
def j12_dangling_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five types of link: to modules, courses, concepts, modules again, prerequisites."""
    parts = table(spark, sf_dir, "part")
    p = F.col("p_partkey")
    links = F.array(*[F.struct(F.lit(link).alias("link"), F.lit(kind).alias("kind"), (p * m % 400).alias("target")) for link, kind, m in _LINKS])
    refs = parts.select(p.alias("owner"), F.explode(links).alias("l")).select("owner", "l.*")
    return records.dangling(refs, parts.select(p.alias("id"), _pick(("Course", "Module", "Concept"), p % 3).alias("kind")))


_SECTIONS = "s AS (SELECT p_partkey AS id, CASE WHEN p_partkey >= 10 THEN p_partkey // 10 + CASE WHEN p_partkey % 37 = 0 THEN 1000000 ELSE 0 END END AS up, length(p_partkey::VARCHAR) + (p_partkey % 17 = 0)::INT AS lvl, p_partkey % 50 AS a, p_partkey % 50 + p_partkey % 9 AS z FROM part)"


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    parent = F.when(p >= 10, F.floor(p / 10) + F.when(p % 37 == 0, 1000000).otherwise(0))
    return table(spark, sf_dir, "part").select(p.alias("section_id"), parent.cast("long").alias("parent_id"), (F.char_length(p.cast("string")) + (p % 17 == 0).cast("int")).alias("level"), (p % 50).alias("start"), (p % 50 + p % 9).alias("end"))


@query(f"""WITH {_SECTIONS}, j AS (SELECT s.*, t.id AS there, t.lvl AS ul, t.a AS ua, t.z AS uz FROM s LEFT JOIN s t ON t.id = s.up)
SELECT id AS section_id, unnest(list_filter([CASE WHEN up IS NULL AND lvl <> 1 THEN 'top-level section must have level 1' END, CASE WHEN up IS NOT NULL AND there IS NULL THEN 'parent not found' END, CASE WHEN there IS NOT NULL AND lvl <> ul + 1 THEN 'level must be parent level + 1' END, CASE WHEN there IS NOT NULL AND NOT (ua <= a AND z <= uz) THEN 'lies outside its parent' END], lambda x: x IS NOT NULL)) AS error FROM j""")
def j14_section_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.section_errors(sections(spark, sf_dir))


@query(f"""WITH {_SECTIONS}, b AS (SELECT l_orderkey * 10 + l_linenumber AS block_id, l_partkey + CASE WHEN l_orderkey % 19 = 0 THEN 5000000 ELSE 0 END AS section_id, l_suppkey % 50 AS x, l_suppkey % 50 + l_linenumber % 3 AS y FROM lineitem)
SELECT block_id, section_id, CASE WHEN id IS NULL THEN 'section not found' ELSE 'lies outside its section' END AS error FROM b LEFT JOIN s ON id = section_id WHERE id IS NULL OR NOT (a <= x AND y <= z)""")
def j15_block_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    x = F.col("l_suppkey") % 50
    blocks = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("block_id"), (F.col("l_partkey") + F.when(F.col("l_orderkey") % 19 == 0, 5000000).otherwise(0)).alias("section_id"), x.alias("start"), (x + F.col("l_linenumber") % 3).alias("end"))
    return records.membership_errors(blocks, sections(spark, sf_dir))


_PAGE = r"CASE doc_id % 5 WHEN 0 THEN 'EN.' || num || ' - Advanced ' || source || chr(10) || text WHEN 1 THEN 'en.' || num || chr(10) || ' The name' || chr(13) || chr(10) || text WHEN 2 THEN 'This course is new' || chr(10) || 'Lecture notes: ' || source || chr(10) || text WHEN 3 THEN chr(10) || '  A class about ' || lang ELSE text END"
_PAGES = f"n AS (SELECT doc_id, text, coalesce(source, '') AS source, coalesce(lang, '') AS lang, (doc_id % 900 + 100) || '.' || (doc_id % 7 + 100) AS num FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, 'EN.' || num AS no, {_PAGE} AS body FROM n), l AS (SELECT *, list_filter(list_transform(string_split(replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls, list_filter(list_transform(string_split(replace(replace(body, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))[1:20], lambda x: trim(x)), lambda x: x <> '') AS head FROM b)"
_LESS = "trim(regexp_replace({}, replace(no, '.', '\\.'), '', 'gi'), ' :-–—')"


def course_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    num = F.concat((F.col("doc_id") % 900 + 100).cast("string"), F.lit("."), (F.col("doc_id") % 7 + 100).cast("string"))
    source, lang, nl = F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.lit("\n")
    k = F.col("doc_id") % 5
    body = F.when(k == 0, F.concat(F.lit("EN."), num, F.lit(" - Advanced "), source, nl, "text")).when(k == 1, F.concat(F.lit("en."), num, nl, F.lit(" The name\r\n"), "text")).when(k == 2, F.concat(F.lit("This course is new\nLecture notes: "), source, nl, "text")).when(k == 3, F.concat(F.lit("\n  A class about "), lang)).otherwise(F.col("text"))
    return d.select("doc_id", F.concat(F.lit("EN."), num).alias("number"), body.alias("body"))


@query(f"""WITH {_PAGES}, p AS (SELECT *, list_position(list_transform(ls, lambda x: contains(lower(x), lower(no))), true) AS i FROM l), c AS (SELECT *, CASE WHEN i > 0 THEN {_LESS.format('ls[i]')} END AS rest FROM p)
SELECT doc_id, CASE WHEN i > 0 AND length(rest) >= 4 THEN rest WHEN i > 0 AND i < len(ls) THEN ls[i + 1] ELSE ls[1] END[1:160] AS name FROM c""")
def t13_course_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return course_pages(spark, sf_dir).select("doc_id", records.course_name(F.col("body"), F.col("number")).alias("name"))


@query(f"""WITH {_PAGES}, c AS (SELECT doc_id, list_filter(list_transform(head, lambda x: CASE WHEN starts_with(lower(x), 'this course') OR starts_with(lower(x), 'course description') OR starts_with(lower(x), 'course overview') THEN NULL WHEN contains(lower(x), lower(no)) AND length({_LESS.format('x')}) >= 4 THEN {_LESS.format('x')}
 WHEN length(x) <= 120 AND regexp_matches(x, '(?i)\\b(course|lecture notes|class)\\b') AND length(trim(regexp_replace(regexp_replace(x, '(?i)\\b(course|lecture notes|class|syllabus)\\b', ' ', 'g'), '\\s+', ' ', 'g'), ' :-–—')) >= 4 THEN trim(regexp_replace(regexp_replace(x, '(?i)\\b(course|lecture notes|class|syllabus)\\b', ' ', 'g'), '\\s+', ' ', 'g'), ' :-–—') END), lambda x: x IS NOT NULL) AS ts FROM l) SELECT doc_id, ts[1][1:160] AS title FROM c""")
def t14_explicit_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return course_pages(spark, sf_dir).select("doc_id", records.explicit_title(F.col("body"), F.col("number")).alias("title"))


_DIFFER = ", ".join(f"CASE WHEN (conv_id + turn) % {i + 5} = 0 THEN '{f}' END" for i, f in enumerate(fixed.LINKED_FIELDS))


@query(f"SELECT conv_id * 100 + turn AS record, array_to_string(list_filter([{_DIFFER}, CASE WHEN turn % 3 = 2 THEN 'confirmed_content' END, CASE WHEN conv_id % 8 = 1 OR turn % 6 > 4 THEN 'recognition_ref' END, CASE WHEN conv_id % 9 = 0 OR turn % 7 > 5 THEN 'validation_status' END], lambda x: x IS NOT NULL), ' ') AS errors FROM conversations WHERE role = 'user'")
def u07_link_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    key = (F.col("conv_id") * 100 + F.col("turn")).alias("record")
    value = lambda f: F.concat(F.lit(f), F.col("conv_id").cast("string"))
    sent = c.select(key, *[value(f).alias(f) for f in fixed.LINKED_FIELDS], F.col("text").alias("submitted_text"))
    changed = [F.when((F.col("conv_id") + F.col("turn")) % (i + 5) != 0, value(f)).alias(f) for i, f in enumerate(fixed.LINKED_FIELDS)]
    content = F.when(F.col("turn") % 3 == 2, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    evidence = c.select(key, *changed, content.alias("confirmed_content"), F.when(F.col("conv_id") % 8 == 1, F.lit("r")).alias("recognition_ref"), F.greatest(F.col("turn") % 6 - 4, F.lit(0)).alias("corrections"), F.when(F.col("conv_id") % 9 == 0, "partial").otherwise("valid").alias("validation_status"), F.greatest(F.col("turn") % 7 - 5, F.lit(0)).alias("ambiguities"))
    return records.link_errors(sent, evidence).withColumn("errors", F.array_join("errors", " "))


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderpriority AS raw, CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority || '+' ELSE o_orderpriority END AS conf, list_filter(range(1, o_orderkey % 4 + 1), lambda i: (o_orderkey + i) % 3 <> 0) AS am FROM orders),
e AS (SELECT id, list_concat(list_transform(am, lambda i: {'location': 'a' || i, 'raw_value': 'x' || i, 'corrected_value': 'y' || i, 'reason': 'ambiguity'}), CASE WHEN conf <> raw OR len(am) = 0 THEN [{'location': 'full_transcription', 'raw_value': raw, 'corrected_value': conf, 'reason': 'transcription'}] ELSE [] END) AS cs FROM r),
x AS (SELECT id, unnest(cs) AS c, generate_subscripts(cs, 1) - 1 AS ordinal FROM e) SELECT id AS recognition_id, ordinal::BIGINT AS ordinal, c.location AS location, c.raw_value AS raw_value, c.corrected_value AS corrected_value, c.reason AS reason FROM x""")
def u10_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    read = F.transform(F.slice(F.sequence(F.lit(1), F.lit(3)), F.lit(1), (k % 4).cast("int")), lambda i: F.struct(F.concat(F.lit("a"), i.cast("string")).alias("id"), F.concat(F.lit("x"), i.cast("string")).alias("raw_value"), F.when((k + i) % 3 != 0, F.concat(F.lit("y"), i.cast("string"))).alias("resolution")))
    o = table(spark, sf_dir, "orders").select(k.alias("recognition_id"), F.col("o_orderpriority").alias("recognized"), F.when(k % 4 == 0, F.concat("o_orderpriority", F.lit("+"))).otherwise(F.col("o_orderpriority")).alias("confirmed"), read.alias("ambiguities"))
    return records.corrections(o)


@query("""WITH s AS (SELECT event_type AS modality, 'p' || user_id % 3 AS provider, event_id % 4 = 0 AS nc, event_id % 3 AS cr, event_id % 5 = 0 AS mc, event_id % 7 = 0 AS fl FROM events)
SELECT coalesce(modality, 'all') AS modality, coalesce(provider, 'all') AS provider, count(*) AS n, round(avg(nc::INT), 6) AS needs_confirmation, round(avg(cr), 6) AS corrections, round(avg(mc::INT), 6) AS meaning_changed, round(avg(fl::INT), 6) AS failed FROM s GROUP BY GROUPING SETS ((modality, provider), (modality), ())""")
def z17_correction_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("modality"), F.concat(F.lit("p"), (F.col("user_id") % 3).cast("string")).alias("provider"), (k % 4 == 0).cast("int").alias("needs_confirmation"), (k % 3).alias("corrections"), (k % 5 == 0).cast("int").alias("meaning_changed"), (k % 7 == 0).cast("int").alias("failed"))
    return records.correction_metrics(e)


@query("SELECT s_suppkey AS module_id, row_number() OVER (ORDER BY s_name) AS listed, s_suppkey + 1 + (s_suppkey % 4 = 0)::INT AS number, coalesce(n, 0) AS concepts FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey QUALIFY listed <> number")
def z20_module_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("module_id"), F.row_number().over(Window.orderBy("s_name")).cast("long").alias("listed"), (F.col("s_suppkey") + 1 + (F.col("s_suppkey") % 4 == 0).cast("int")).alias("number"))  # the modules of one course
    return records.module_order_errors(s, table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("module_id")))
