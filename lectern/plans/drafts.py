"""Queries of retrieval plans and bundles: students' turns as contexts, parts as the course's concepts, orders as bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import bundles, plan
from .base import query, quoted, table

_NEEDS_OF = "[" + ", ".join("[" + quoted(r[3]) + "]::VARCHAR[]" for r in fixed.GROUNDING_POLICY) + "]"
_PURPOSES_OF = "[" + ", ".join("[" + quoted(r[2]) + "]::VARCHAR[]" for r in fixed.GROUNDING_POLICY) + "]"
_CTX = f"""ctx AS (SELECT conv_id * 100 + turn AS turn_id, conv_id * 7 + turn * 3 AS k, text,
 CASE WHEN conv_id % 3 = 0 THEN [(conv_id * 7 + turn * 3) % 150, 1000000 + turn] ELSE [] END AS schema_ids,
 CASE WHEN conv_id % 3 <> 2 THEN [(conv_id * 7 + turn * 3) * 5 % 150, ((conv_id * 7 + turn * 3) * 11 + 1) % 150] ELSE [] END AS linked_ids,
 CASE WHEN turn % 4 = 0 THEN '' ELSE text[1:30] END AS intent, text[1:50] AS prompt, {_NEEDS_OF}[((conv_id + turn) % 12 + 1)::INT] AS need_types FROM conversations WHERE role = 'user')"""
_DRAFT = f"""{_CTX}, listed AS (SELECT turn_id, 'question_schema' AS source, unnest(schema_ids) AS concept_id, generate_subscripts(schema_ids, 1) AS ix FROM ctx UNION ALL SELECT turn_id, 'linked', unnest(linked_ids), generate_subscripts(linked_ids, 1) FROM ctx),
known AS (SELECT l.*, p_name AS name, p_brand AS module, bool_or(source = 'question_schema') OVER (PARTITION BY turn_id) AS has FROM listed l JOIN part ON p_partkey = concept_id),
c AS (SELECT *, CASE WHEN has OR row_number() OVER (PARTITION BY turn_id ORDER BY ix) = 1 THEN 'primary' ELSE 'related' END AS role FROM known WHERE has = (source = 'question_schema')),
g AS (SELECT turn_id, string_agg(concept_id || ':' || source || ':' || role, ' ' ORDER BY ix) AS concepts, list(name ORDER BY ix) FILTER (role = 'primary') AS names, first(concept_id ORDER BY ix) FILTER (role = 'primary') AS top, list_sort(list_distinct(list(module))) AS modules FROM c GROUP BY 1),
d AS (SELECT ctx.*, concepts, names, top, modules, coalesce(array_to_string(names, ', '), '') AS topic FROM ctx LEFT JOIN g USING (turn_id))"""
_TEMPLATES = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.NEED_QUERIES.items()) + " END"


def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    k = F.col("conv_id") * 7 + F.col("turn") * 3
    none = F.array().cast("array<bigint>")
    needs = F.array(*[F.array(*[F.lit(n) for n in r[3]]).cast("array<string>") for r in fixed.GROUNDING_POLICY])
    purposes = F.array(*[F.array(*[F.lit(n) for n in r[2]]).cast("array<string>") for r in fixed.GROUNDING_POLICY])
    at = ((F.col("conv_id") + F.col("turn")) % 12 + 1).cast("int")
    return c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("turn_id"), k.alias("k"), "text", F.when(F.col("conv_id") % 3 == 0, F.array(k % 150, 1000000 + F.col("turn"))).otherwise(none).alias("schema_ids"),
        F.when(F.col("conv_id") % 3 != 2, F.array(k * 5 % 150, (k * 11 + 1) % 150)).otherwise(none).alias("linked_ids"), F.when(F.col("turn") % 4 == 0, "").otherwise(F.substring("text", 1, 30)).alias("intent"),
        F.substring("text", 1, 50).alias("prompt"), F.element_at(needs, at).alias("need_types"), F.element_at(purposes, at).alias("purposes"),
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("concept_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("module_id"))


def _shown(needs: str) -> Column:
    return F.coalesce(F.array_join(F.transform(needs, lambda n: F.concat_ws("|", n["need_id"], n["need_type"], n["query"], F.coalesce(n["anchor"], F.lit("")), F.coalesce(n["concept_id"].cast("string"), F.lit("")))), "; "), F.lit(""))


@query(rf"""WITH {_DRAFT} SELECT turn_id, CASE WHEN len(names) > 0 THEN 'found' ELSE 'none_found' END AS status,
 trim(regexp_replace(CASE WHEN topic <> '' AND intent <> '' THEN topic || ': ' || intent WHEN topic <> '' THEN topic WHEN intent <> '' THEN intent ELSE prompt END, '\s+', ' ', 'g'))[1:300] AS main_query, coalesce(concepts, '') AS concepts, coalesce(array_to_string(modules, ' '), '') AS modules,
 CASE WHEN len(names) > 0 THEN array_to_string(list_transform(need_types[1:2], lambda t, i: 'n' || i || '|' || t || '|' || ({_TEMPLATES} || array_to_string(names, ' and '))[1:200] || '|' || CASE WHEN t IN ('definition', 'theorem_statement') AND len(names) = 1 THEN names[1] ELSE '' END || '|' || top), '; ') ELSE '' END AS needs FROM d""")
def p07_plan_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = plan.drafted(contexts(spark, sf_dir), catalog(spark, sf_dir))
    concepts = F.array_join(F.transform("concepts", lambda c: F.concat_ws(":", c["concept_id"].cast("string"), c["source"], c["role"])), " ")
    return d.select("turn_id", F.col("concept_status").alias("status"), "main_query", concepts.alias("concepts"), F.coalesce(F.array_join("module_ids", " "), F.lit("")).alias("modules"), _shown("needs").alias("needs"))


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model may say about the turns: known, unknown and repeated concepts, none in the course, empty, long, odd and repeated needs."""
    k = F.col("k")
    types = F.array(*[F.lit(t) for t in (*fixed.NEED_TYPES, "odd")])
    need = lambda i: F.struct(F.element_at(types, ((k + i) % 10 + 1).cast("int")).alias("need_type"), F.when((k + i) % 6 == 0, " ").when((k + i) % 13 == 1, F.repeat(F.lit("long words "), 30)).otherwise(F.concat(F.lit("what  about "), ((k + i) % 3).cast("string"))).alias("description"), F.when(i % 2 == 0, " anchor ").alias("anchor"), F.when((k + i) % 4 == 0, k % 150).when((k + i) % 4 == 1, F.lit(5_000_000).cast("bigint")).alias("concept_id"))
    needs = F.transform(F.sequence(F.lit(1).cast("bigint"), k % 7 + 1), need)
    first = F.when(k % 5 == 0, F.lit(-1).cast("bigint")).when(k % 5 == 1, F.lit(9_000_000).cast("bigint")).when(k % 5 != 4, k * 3 % 150)
    return contexts(spark, sf_dir).select("turn_id", first.alias("concept_id"), F.when(k % 3 != 0, F.array(k % 150, k * 3 % 150, F.lit(8_000_000).cast("bigint"), (k + 9) % 150, (k + 20) % 150)).alias("related_ids"), F.when(k % 4 != 0, F.concat(F.lit("the   query of "), F.col("text"))).alias("query"), F.slice(needs, 1, F.when(k % 11 == 0, 0).otherwise(9)).alias("needs"))


_TYPES = "[" + quoted((*fixed.NEED_TYPES, "odd")) + "]"


def _finalized_sql() -> str:
    """Finalised plans without folds: what a list's earlier elements leave to a later one is said by positions. Each layer adds columns to the ones before."""
    said = lambda *cases: "list_filter([" + ", ".join(f"CASE WHEN {t} THEN '{m}' END" for t, m in cases) + "], lambda x: x IS NOT NULL)"
    plain = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    types = quoted(fixed.NEED_TYPES)
    need = f"""{{'need_type': {_TYPES}[(k + i) % 10 + 1], 'description': CASE WHEN (k + i) % 6 = 0 THEN ' ' WHEN (k + i) % 13 = 1 THEN repeat('long words ', 30) ELSE 'what  about ' || (k + i) % 3 END,
      'anchor': CASE WHEN i % 2 = 0 THEN ' anchor ' END, 'concept_id': CASE WHEN (k + i) % 4 = 0 THEN k % 150 WHEN (k + i) % 4 = 1 THEN 5000000 END}}"""
    layers = [
        # what was proposed
        f"""CASE k % 5 WHEN 0 THEN -1 WHEN 1 THEN 9000000 WHEN 4 THEN NULL ELSE k * 3 % 150 END AS one, CASE WHEN k % 3 <> 0 THEN [k % 150, k * 3 % 150, 8000000, (k + 9) % 150, (k + 20) % 150] ELSE [] END AS rel,
        {plain("CASE WHEN k % 4 <> 0 THEN 'the   query of ' || text ELSE '' END")} AS asked, CASE WHEN k % 11 = 0 THEN [] ELSE list_transform(range(1, k % 7 + 2), lambda i: {need}) END AS proposed,
        coalesce(dr0, []) AS dr, {plain("CASE WHEN topic <> '' AND intent <> '' THEN topic || ': ' || intent WHEN topic <> '' THEN topic WHEN intent <> '' THEN intent ELSE prompt END")}[1:{fixed.MAX_MAIN_CHARS}] AS main0,
        CASE WHEN len(names) > 0 THEN list_transform(need_types[1:{fixed.DRAFT_NEEDS}], lambda t: {{'t': t, 'q': ({_TEMPLATES} || array_to_string(names, ' and '))[1:{fixed.MAX_NEED_CHARS}], 'a': CASE WHEN t IN ('definition', 'theorem_statement') AND len(names) = 1 THEN names[1] END, 'c': top}}) ELSE [] END AS needs0""",
        "list_filter(dr, lambda x: x.source = 'question_schema') AS qs, coalesce(one = -1, false) AS away, coalesce(list_contains(kn, one), false) AS isk",
        "one IS NOT NULL AND NOT away AS chosen, list_contains(list_transform(qs, lambda x: x.concept_id), one) AS inqs",
        "chosen AND isk AND NOT coalesce(inqs, false) AS added",
        f"""CASE WHEN added THEN list_append(qs, {{'concept_id': one, 'source': 'model', 'role': CASE WHEN len(qs) > 0 THEN 'related' ELSE 'primary' END}}) ELSE qs END AS c1,
        {said(("chosen AND NOT isk", "concept_id unknown_concept_dropped"), ("added AND len(qs) > 0", "concept_id question_schema_kept_primary"))} AS r1""",
        f"""list_filter(rel, lambda x, i: coalesce(list_contains(kn, x), false) AND NOT list_contains(list_transform(c1, lambda y: y.concept_id), x) AND list_position(rel, x) = i) AS fresh,
        ({fixed.MAX_RELATED} - len(list_filter(c1, lambda x: x.role = 'related')))::INT AS room""",
        "len(fresh) > room AS cut, CASE WHEN len(fresh) > room THEN list_position(rel, fresh[room + 1]) ELSE len(rel) + 1 END AS stop",
        f"""list_concat(c1, list_transform(fresh[1:room], lambda x: {{'concept_id': x, 'source': 'model', 'role': 'related'}})) AS c,
        list_concat(r1, list_transform(list_filter(rel, lambda x, i: i < stop AND NOT coalesce(list_contains(kn, x), false)), lambda x: 'related_concept_ids unknown_concept_dropped'), {said(("cut", "related_concept_ids truncated"))}) AS r2,
        away AND len(qs) > 0 AS ignored""",
        "away AND NOT ignored AS outside",
        "NOT outside AND len(list_filter(c, lambda x: x.role = 'primary')) = 0 AS lacking",
        "lacking AND len(dr) > 0 AS drafted, lacking AND len(dr) = 0 AND len(c) > 0 AS raised",
        """CASE WHEN drafted THEN list_concat(dr, list_filter(c, lambda x: NOT list_contains(list_transform(dr, lambda y: y.concept_id), x.concept_id)))
        WHEN raised THEN list_transform(c, lambda x, i: {'concept_id': x.concept_id, 'source': x.source, 'role': CASE WHEN i = 1 THEN 'primary' ELSE x.role END}) ELSE c END AS c2""",
        f"""c2[1:{fixed.MAX_CONCEPTS}] AS c3, list_concat(r2, {said(("ignored", "concept_id not_in_course_ignored"), ("drafted AND one IS NOT NULL", "concept_id concepts_from_draft"), ("raised", "related_concept_ids first_related_promoted_to_primary"),
        (f"len(c2) > {fixed.MAX_CONCEPTS}", "concepts truncated"), ("length(asked) < 3", "query main_query_from_draft"), (f"length(asked) > {fixed.MAX_MAIN_CHARS}", "query truncated"))}) AS r3""",
        f"""list_transform(c3, lambda x: x.concept_id) AS ids, list_transform(list_filter(c3, lambda x: x.role = 'primary'), lambda x: x.concept_id) AS prim,
        list_transform(proposed, lambda n: {{'t': n.need_type, 'w': {plain('n.description')}, 'a': n.anchor, 'c': n.concept_id, 'bad': n.need_type NOT IN ({types})}}) AS n1""",
        f"list_transform(n1, lambda n: CASE WHEN n.bad OR length(n.w) < 3 THEN NULL ELSE lower(n.w[1:{fixed.MAX_NEED_CHARS}]) END) AS keys",
        "list_filter(range(1, len(n1) + 1), lambda i: keys[i] IS NOT NULL AND list_position(keys, keys[i]) = i) AS good",
        f"""list_transform(good, lambda i: {{'t': n1[i].t, 'q': n1[i].w[1:{fixed.MAX_NEED_CHARS}], 'a': CASE WHEN trim(coalesce(n1[i].a, '')) <> '' THEN trim(n1[i].a)[1:80] END,
        'c': CASE WHEN n1[i].c IS NOT NULL AND list_contains(ids, n1[i].c) THEN n1[i].c WHEN len(prim) = 1 THEN prim[1] END}}) AS n2,
        flatten(list_transform(range(1, len(n1) + 1), lambda i: list_transform(list_filter([CASE WHEN n1[i].bad THEN 'invalid_need_dropped' WHEN length(n1[i].w) < 3 THEN 'empty_need_dropped' END,
        CASE WHEN keys[i] IS NOT NULL AND length(n1[i].w) > {fixed.MAX_NEED_CHARS} THEN 'truncated' END, CASE WHEN keys[i] IS NOT NULL AND list_position(keys, keys[i]) < i THEN 'duplicate_dropped' END,
        CASE WHEN list_contains(good, i) AND n1[i].c IS NOT NULL AND NOT list_contains(ids, n1[i].c) THEN 'not_a_plan_concept_dropped' END], lambda x: x IS NOT NULL), lambda x: 'evidence_needs[' || (i - 1) || '] ' || x))) AS r4""",
        "CASE WHEN len(n2) = 0 THEN needs0 ELSE n2 END AS every",
    ]
    turn = f"SELECT d.*, dr0, coalesce(kn0, []) AS kn FROM d LEFT JOIN gl USING (turn_id) LEFT JOIN kns USING (turn_id)"
    for layer in layers:
        turn = f"SELECT *, {layer} FROM ({turn})"
    repairs = f"list_concat(r3, r4, {said(('len(n2) = 0', 'evidence_needs needs_from_draft'), (f'len(every) > {fixed.MAX_NEEDS}', 'evidence_needs truncated'))})"
    return f"""WITH {_DRAFT}, gl AS (SELECT turn_id, list({{'concept_id': concept_id, 'source': source, 'role': role}} ORDER BY ix) AS dr0 FROM c GROUP BY 1),
said AS (SELECT turn_id, unnest([k * 3 % 150, k % 150, (k + 9) % 150, (k + 20) % 150]) AS x FROM ctx), kns AS (SELECT turn_id, list(DISTINCT x) AS kn0 FROM said JOIN part ON p_partkey = x GROUP BY 1)
SELECT turn_id, CASE WHEN outside THEN 'not_in_course' WHEN len(prim) > 0 THEN 'found' ELSE 'none_found' END AS status, CASE WHEN length(asked) < 3 THEN main0 ELSE asked[1:{fixed.MAX_MAIN_CHARS}] END AS main_query,
coalesce(array_to_string(list_transform(c3, lambda x: x.concept_id || ':' || x.source || ':' || x.role), ' '), '') AS concepts,
coalesce(array_to_string(list_transform(every[1:{fixed.MAX_NEEDS}], lambda n: n.t || '|' || n.q || '|' || coalesce(n.a, '') || '|' || coalesce(n.c::VARCHAR, '')), '; '), '') AS needs, coalesce(array_to_string({repairs}, '; '), '') AS repairs FROM ({turn})"""


@query(_finalized_sql())
def p08_plan_finalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proposals of a model over their drafts, repaired."""
    concepts = catalog(spark, sf_dir)
    f = plan.finalized(proposals(spark, sf_dir), plan.drafted(contexts(spark, sf_dir), concepts), concepts)
    shown = F.array_join(F.transform("concepts", lambda c: F.concat_ws(":", c["concept_id"].cast("string"), c["source"], c["role"])), " ")
    needs = F.array_join(F.transform("needs", lambda n: F.concat_ws("|", n["need_type"], n["query"], F.coalesce(n["anchor"], F.lit("")), F.coalesce(n["concept_id"].cast("string"), F.lit("")))), "; ")
    return f.select("turn_id", F.col("concept_status").alias("status"), "main_query", shown.alias("concepts"), needs.alias("needs"), F.array_join("repairs", "; ").alias("repairs"))


_PLANS = f"""{_CTX}, p AS (SELECT turn_id, k, ['found', 'none_found', 'not_in_course', 'odd'][k % 4 + 1] AS status, repeat('ab ', (k % 130)::INT) AS main_query, ['draft', 'model', 'human'][k % 3 + 1] AS origin, ['not_enforced', 'module', 'section', 'page'][k % 4 + 1] AS narrowing,
 list_transform(range(0, k % 5), lambda i: {{'concept_id': i, 'source': ['question_schema', 'linked', 'model', 'other'][(k + i) % 4 + 1], 'role': ['primary', 'related', 'none'][(k + 2 * i) % 3 + 1]}}) AS concepts,
 list_transform(range(1, k % 6 + 1), lambda i: {{'need_id': 'n' || (i + (k % 7 = 0)::INT), 'need_type': {_TYPES}[(k + i) % 10 + 1], 'query': repeat('q', ((k * i) % 240)::INT), 'concept_id': CASE WHEN k % 4 = 0 THEN 3 WHEN k % 4 = 1 THEN 0 END}}) AS needs FROM ctx)"""


@query(f"""WITH {_PLANS}, e AS (SELECT turn_id, list_concat(
 list_filter([CASE WHEN NOT length(main_query) BETWEEN 3 AND 300 THEN 'main_query length' END, CASE WHEN len(concepts) > 3 THEN 'too many concepts' END], lambda x: x IS NOT NULL),
 flatten(list_transform(concepts, lambda c: list_filter([CASE WHEN c.source NOT IN ('question_schema', 'linked', 'model') THEN 'concept source' END, CASE WHEN c.role NOT IN ('primary', 'related') THEN 'concept role' END], lambda x: x IS NOT NULL))),
 list_filter([CASE WHEN status = 'odd' THEN 'concept_status' END, CASE WHEN status <> 'odd' AND (status = 'found') <> (len(list_filter(concepts, lambda c: c.role = 'primary')) > 0) THEN 'concept_status does not match the primary concepts' END, CASE WHEN NOT len(needs) BETWEEN 1 AND 4 THEN 'needs count' END], lambda x: x IS NOT NULL),
 flatten(list_transform(needs, lambda n, i: list_filter([CASE WHEN n.need_id <> 'n' || i THEN 'need_id' END, CASE WHEN n.need_type = 'odd' THEN 'need_type' END, CASE WHEN NOT length(n.query) BETWEEN 3 AND 200 THEN 'need query length' END, CASE WHEN n.concept_id IS NOT NULL AND n.concept_id >= len(concepts) THEN 'need concept not in plan' END], lambda x: x IS NOT NULL))),
 list_filter([CASE WHEN origin = 'human' THEN 'origin' END, CASE WHEN narrowing = 'page' THEN 'scope.narrowing' END], lambda x: x IS NOT NULL)) AS problems FROM p) SELECT turn_id, array_to_string(problems, '; ') AS problems FROM e""")
def p09_plan_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, pick = F.col("k"), lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    concepts = F.transform(F.slice(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint")), F.lit(1), (k % 5).cast("int")), lambda i: F.struct(i.alias("concept_id"), pick(("question_schema", "linked", "model", "other"), (k + i) % 4).alias("source"), pick(("primary", "related", "none"), (k + 2 * i) % 3).alias("role")))
    needs = F.transform(F.slice(F.sequence(F.lit(1).cast("bigint"), F.lit(5).cast("bigint")), F.lit(1), (k % 6).cast("int")), lambda i: F.struct(F.concat(F.lit("n"), (i + (k % 7 == 0).cast("int")).cast("string")).alias("need_id"), pick((*fixed.NEED_TYPES, "odd"), (k + i) % 10).alias("need_type"), F.repeat(F.lit("q"), (k * i % 240).cast("int")).alias("query"), F.when(k % 4 == 0, F.lit(3).cast("bigint")).when(k % 4 == 1, F.lit(0).cast("bigint")).alias("concept_id")))
    p = contexts(spark, sf_dir).select("turn_id", pick(("found", "none_found", "not_in_course", "odd"), k % 4).alias("status"), F.repeat(F.lit("ab "), (k % 130).cast("int")).alias("q"), concepts.alias("c"), needs.alias("n"), pick(("draft", "model", "human"), k % 3).alias("o"), pick(("not_enforced", "module", "section", "page"), k % 4).alias("w"))
    return p.select("turn_id", F.array_join(plan.plan_problems(*[F.col(c) for c in ("status", "q", "c", "n", "o", "w")]), "; ").alias("problems"))


@query(f"WITH {_CTX}, cat AS (SELECT list(p_partkey ORDER BY p_partkey) AS ids FROM part) SELECT turn_id, array_to_string(CASE WHEN len(ids) <= 40 THEN ids ELSE list_concat(list_distinct_in_order, list_filter(ids[1:40], lambda x: NOT list_contains(linked_ids, x)))[1:40] END, ' ') AS menu FROM (SELECT *, linked_ids AS list_distinct_in_order FROM ctx), cat")
def p10_concept_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.col("p_partkey").alias("concept_id"))
    m = plan.concept_menu(contexts(spark, sf_dir).select("turn_id", F.col("linked_ids").alias("hits")), parts)
    return m.select("turn_id", F.array_join(F.transform("menu", lambda x: x.cast("string")), " ").alias("menu"))


@query(f"""WITH {_CTX}, a AS (SELECT turn_id, list_filter([CASE WHEN k % 2 = 0 THEN 'query' END, CASE WHEN k % 3 = 0 THEN 'course_id' END, 'purpose', CASE WHEN k % 5 = 0 THEN 'top_k' END], lambda x: x IS NOT NULL) AS fields, CASE WHEN k % 11 <> 0 THEN repeat('q ', (k % 170)::INT) END AS query, [{quoted(fixed.PURPOSES)}][k % 9 + 1] AS purpose,
 CASE WHEN k % 13 <> 0 THEN list_transform(range(0, k % 6), lambda i: {{'need_type': {_TYPES}[(k + i) % 10 + 1], 'description': CASE WHEN (k + i) % 4 = 0 THEN ' ' ELSE 'about' END}}) END AS needs FROM ctx)
SELECT turn_id, array_to_string(list_concat(list_transform(list_filter(fields, lambda f: f NOT IN ({quoted(fixed.TOOL_FIELDS)})), lambda f: f || ' unknown_field'), list_filter([CASE WHEN query IS NULL OR NOT length(trim(query)) BETWEEN 3 AND 300 THEN 'query invalid' END, CASE WHEN purpose NOT IN ({quoted(fixed.MODEL_PURPOSES)}) THEN 'purpose invalid_enum' END, CASE WHEN needs IS NULL OR NOT len(needs) BETWEEN 1 AND 4 THEN 'evidence_needs invalid' END], lambda x: x IS NOT NULL),
 CASE WHEN needs IS NOT NULL AND len(needs) BETWEEN 1 AND 4 THEN list_filter(list_transform(needs, lambda n, i: CASE WHEN n.need_type = 'odd' THEN 'evidence_needs[' || (i - 1) || '].need_type invalid_enum' WHEN trim(n.description) = '' THEN 'evidence_needs[' || (i - 1) || '].description missing' END), lambda x: x IS NOT NULL) ELSE [] END), '; ') AS errors FROM a""")
def p11_argument_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, pick = F.col("k"), lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    fields = F.array_compact(F.array(F.when(k % 2 == 0, "query"), F.when(k % 3 == 0, "course_id"), F.lit("purpose"), F.when(k % 5 == 0, "top_k")))
    needs = F.transform(F.slice(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint")), F.lit(1), (k % 6).cast("int")), lambda i: F.struct(pick((*fixed.NEED_TYPES, "odd"), (k + i) % 10).alias("need_type"), F.when((k + i) % 4 == 0, " ").otherwise("about").alias("description")))
    errors = plan.argument_errors(fields, F.when(k % 11 != 0, F.repeat(F.lit("q "), (k % 170).cast("int"))), pick(fixed.PURPOSES, k % 9), F.when(k % 13 != 0, needs))
    return contexts(spark, sf_dir).select("turn_id", F.array_join(errors, "; ").alias("errors"))


@query(rf"""WITH {_CTX}, a AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'as said: ' || text[1:80] ELSE 'definition  of the term' END AS query, [{quoted(fixed.MODEL_PURPOSES)}][k % 7 + 1] AS purpose FROM ctx), w AS (SELECT *, string_split(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), ' ') AS ws, trim(regexp_replace(query, '\s+', ' ', 'g')) AS q FROM a)
SELECT turn_id, q AS query, CASE WHEN k % 10 = 1 OR len(list_filter(range(1, greatest(1, len(ws) - 4)), lambda i: contains(lower(q), array_to_string(ws[i:i + 5], ' ')))) > 0 THEN 'student_text' ELSE 'structured' END AS query_origin, purpose, array_to_string(list_transform(need_types, lambda n, i: 'n' || i || ' ' || n), '; ') AS needs, text[1:2000] AS scope_check_text, CASE WHEN purpose IN ({quoted(fixed.LEAK_PURPOSES)}) THEN array_to_string([k, k + 1, k + 2], ' ') END AS exclude FROM w""")
def p12_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    args = contexts(spark, sf_dir).select("turn_id", k.alias("question_id"), F.array(k + 1, k + 2).alias("siblings"), F.when(k % 3 == 0, F.concat(F.lit("as said: "), F.substring("text", 1, 80))).otherwise("definition  of the term").alias("query"), F.element_at(F.array(*[F.lit(p) for p in fixed.MODEL_PURPOSES]), (k % 7 + 1).cast("int")).alias("purpose"), F.col("need_types").alias("needs"), (k % 10 == 1).alias("says_student_words"), F.col("text").alias("message"))
    r = plan.request(args)
    return r.withColumn("needs", F.array_join("needs", "; ")).withColumn("exclude", F.array_join(F.transform("exclude", lambda x: x.cast("string")), " "))


@query(rf"""WITH {_DRAFT}, s AS (SELECT turn_id, intent, coalesce(array_to_string(names, ', '), '') AS n FROM d), t AS (SELECT turn_id, CASE WHEN intent <> '' THEN intent ELSE n END AS topic, CASE WHEN n <> '' THEN n WHEN intent <> '' THEN intent ELSE n END AS concept FROM s)
SELECT turn_id, (CASE WHEN lower(trim(topic)) = lower(trim(concept)) THEN concept ELSE concept || ': ' || topic END)[1:300] AS query FROM t""")
def p12_prefetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = contexts(spark, sf_dir)
    d = plan.drafted(c, catalog(spark, sf_dir)).join(c.select("turn_id", "intent"), "turn_id")
    names = F.transform(F.filter("concepts", lambda x: x["role"] == "primary"), lambda x: x["name"])
    return d.select("turn_id", plan.prefetch_query(names, F.col("intent")).alias("query"))


@query(f"WITH {_CTX}, a AS (SELECT turn_id, list_filter({_PURPOSES_OF}[(((turn_id // 100) + (turn_id % 100)) % 12 + 1)::INT], lambda p: p IN ({quoted(fixed.MODEL_PURPOSES)})) AS own FROM ctx) SELECT turn_id, array_to_string(CASE WHEN len(own) > 0 THEN own ELSE [{quoted(fixed.MODEL_PURPOSES)}] END, ' ') AS purposes FROM a")
def p13_tool_purposes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts(spark, sf_dir).select("turn_id", F.array_join(plan.allowed_purposes(F.col("purposes")), " ").alias("purposes"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_partkey NOT IN (o_orderkey * 7 % 200, o_custkey % 200)")
def r16_leak_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("request_id"), F.col("l_partkey").alias("question_id"), "l_linenumber").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id")), "request_id", "left_semi")
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.array(F.col("o_orderkey") * 7 % 200, F.col("o_custkey") % 200).alias("exclude"))
    return plan.without_questions(results, requests).select(F.col("request_id").alias("l_orderkey"), "l_linenumber")


_WANTS = " OR ".join(f"(nt = '{k}' AND bt IN ({quoted(v)}))" for k, v in fixed.PREFERRED_BLOCKS.items() if v)


@query(f"""WITH r AS (SELECT l_orderkey AS need_id, l_linenumber AS passage_id, [{quoted(fixed.LABELLED)}][l_partkey % 8 + 1] AS bt, l_quantity / 100 AS score, [{quoted(fixed.NEED_TYPES)}][l_orderkey % 9 + 1] AS nt FROM lineitem), s AS (SELECT *, score + CASE WHEN {_WANTS} THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS v FROM r)
SELECT need_id, passage_id, row_number() OVER (PARTITION BY need_id ORDER BY v DESC, passage_id) AS rank FROM s""")
def z21_preferred_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    blocks, needs = (F.array(*[F.lit(x) for x in xs]) for xs in (fixed.LABELLED, fixed.NEED_TYPES))
    results = l.select(F.col("l_orderkey").alias("need_id"), F.col("l_linenumber").alias("passage_id"), F.element_at(blocks, (F.col("l_partkey") % 8 + 1).cast("int")).alias("block_type"), (F.col("l_quantity") / 100).alias("score"))
    of = l.select(F.col("l_orderkey").alias("need_id")).distinct().withColumn("need_type", F.element_at(needs, (F.col("need_id") % 9 + 1).cast("int")))
    return plan.preferring(results, of).select("need_id", "passage_id", F.col("rank").cast("long").alias("rank"))


@query("SELECT d.doc_id, d.lang FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id) WHERE NOT coalesce(d.lang IN ('en', 'fr') AND l.quality = 0, false)")
def e03_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    review = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("q"))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(review, "doc_id", "left")
    return bundles.eligible(d.select("doc_id", "lang", F.when(F.col("lang").isin("en", "fr"), "none").otherwise("all").alias("allow"), F.when(F.col("q") == 0, "unverified").when(F.col("q") == 1, "reviewed").alias("review_status"))).select("doc_id", "lang")


@query("SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents WHERE coalesce(source NOT IN ('src0', 'src3', 'src7'), true)")
def r12_reference_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("request_id"), "doc_id", F.col("doc_id").alias("rank"), F.col("source").alias("source_type"))
    return bundles.located(d, ["src0", "src3", "src7"]).select(F.col("request_id").alias("lang"), "doc_id", "rank")


@query("SELECT l_orderkey, string_agg(l_suppkey, ' ' ORDER BY ix, l_suppkey) AS sources FROM (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS ix FROM lineitem GROUP BY ALL) GROUP BY 1")
def r15_distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("x"))
    return by.select("l_orderkey", F.array_join(F.transform(bundles.distinct_in_order(F.transform("x", lambda s: s["l_suppkey"])), lambda s: s.cast("string")), " ").alias("sources"))


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS b, l_linenumber AS p FROM lineitem), n AS (SELECT o_orderkey AS b, i AS ordinal, ['covered', 'partially_covered', 'not_covered'][(o_orderkey + i) % 3 + 1] AS cov FROM orders, range(1, 5) r(i)),
s AS (SELECT p.b, p.p, string_agg('n' || ordinal || ' (' || cov || ')', ', ' ORDER BY ordinal) AS supports FROM p JOIN n ON n.b = p.b AND (p.p = ordinal OR p.p = (p.b + ordinal) % 5) WHERE cov <> 'not_covered' GROUP BY ALL)
SELECT p.b AS bundle_id, p.p::BIGINT AS passage_id, 'P' || row_number() OVER (PARTITION BY p.b ORDER BY p.p) AS label, s.supports IS NOT NULL AS citable, coalesce(s.supports, '') AS supports FROM p LEFT JOIN s ON s.b = p.b AND s.p = p.p""")
def e18_model_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    passages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("bundle_id"), F.col("l_linenumber").cast("long").alias("passage_id"), F.col("l_linenumber").alias("rank")).distinct()
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bundle_id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("ordinal"))
    levels = F.array(F.lit("covered"), F.lit("partially_covered"), F.lit("not_covered"))
    coverage = o.select("bundle_id", "ordinal", F.concat(F.lit("n"), F.col("ordinal").cast("string")).alias("need_id"), F.element_at(levels, ((F.col("bundle_id") + F.col("ordinal")) % 3 + 1).cast("int")).alias("coverage"), F.array(F.col("ordinal").cast("long"), (F.col("bundle_id") + F.col("ordinal")) % 5).alias("passage_ids"))
    return bundles.model_view(passages, coverage).withColumn("supports", F.array_join("supports", ", "))


@query("""WITH d AS (SELECT *, 'cv-src-' || sha256(text)[1:12] AS v, length(text) - length(replace(text, chr(10), '')) + 1 AS n FROM documents WHERE text IS NOT NULL)
SELECT 'psg_' || sha256(doc_id || '|' || v || '|None|1|' || n)[1:16] AS passage_id, doc_id AS document_id, v AS content_version, md5(trim(text)) AS text_md5, doc_id % 40 + 1 AS retrieval_rank, CASE lang WHEN 'en' THEN 'Lecture notes' WHEN 'de' THEN 'Textbook' ELSE 'AI-prepared material' END || CASE WHEN doc_id % 3 <> 0 THEN ', ' || source ELSE '' END AS source_label FROM d""")
def e20_public_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    rows = d.select(F.col("doc_id").alias("document_id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.lit(1).alias("start"), (F.char_length("text") - F.char_length(F.translate("text", "\n", "")) + 1).alias("end"), F.col("text").alias("body"), F.col("lang").alias("source_type"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("section_path"), (F.col("doc_id") % 40 + 1).alias("rank"))
    out = bundles.public_record(rows, {"en": "Lecture notes", "de": "Textbook"}, "AI-prepared material")
    return out.withColumn("text_md5", F.md5(F.col("passage_text").cast("binary"))).drop("passage_text")


@query("SELECT o_custkey AS session_id, o_orderkey % 3 AS turn_id, string_agg(o_orderkey, ' ' ORDER BY o_orderkey) AS bundles FROM orders GROUP BY ALL")
def e21_turn_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    issued = o.select(F.col("o_orderkey").alias("issued"), F.col("o_orderkey").alias("bundle_id"), F.col("o_custkey").alias("session_id"), (F.col("o_orderkey") % 3).alias("turn_id"))
    return bundles.registered(issued).withColumn("bundles", F.array_join(F.transform("bundles", lambda b: b.cast("string")), " "))


@query("SELECT l_partkey AS passage_id, min(l_orderkey) AS bundle_id FROM lineitem GROUP BY 1")
def e21_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundles.resolved(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("issued"), F.col("l_orderkey").alias("bundle_id"), F.col("l_partkey").alias("passage_id")))
