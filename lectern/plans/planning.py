"""Queries of planning: the grounding policy and concept linking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import policy
from .base import query, table
from .texts import link_sql

_ACTIONS = "[" + ", ".join(f"'{r[0]}'" for r in fixed.GROUNDING_POLICY) + "]"
_TABLE = "(VALUES " + ", ".join(f"('{a}', '{m}', [{', '.join(repr(n) for n in needs)}]::VARCHAR[])" for a, m, _, needs, _, _ in fixed.GROUNDING_POLICY) + ") p(action, mode, need_types)"


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(r[0]) for r in fixed.GROUNDING_POLICY])
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.element_at(names, ((F.col("conv_id") + F.col("turn")) % 12 + 1).cast("int")).alias("action"), (F.col("turn") % 2 == 0).alias("states_content"), (F.col("conv_id") % 3 == 0).alias("checks_convention"), (F.col("conv_id") % 7 != 0).alias("ready"))


_MODES = f"""SELECT conv_id, turn, action, CASE WHEN NOT ready AND m IN ('must', 'may') THEN 'not_needed' ELSE m END AS mode, array_to_string(nt, ' ') AS need_types FROM (
SELECT *, CASE WHEN action = 'hint' AND NOT states THEN 'may' WHEN action = 'verify' AND conv THEN 'may' ELSE mode END AS m, CASE WHEN action = 'verify' AND conv THEN ['notation_convention'] ELSE need_types END AS nt
FROM (SELECT conv_id, turn, {_ACTIONS}[((conv_id + turn) % 12 + 1)::INT] AS action, turn % 2 = 0 AS states, conv_id % 3 = 0 AS conv, conv_id % 7 <> 0 AS ready FROM conversations) JOIN {_TABLE} USING (action))"""


@query(_MODES)
def p01_p02_policy_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.recommended(actions(spark, sf_dir), policy.policy_table(spark)).select("conv_id", "turn", "action", "mode", F.array_join("need_types", " ").alias("need_types"))


@query(f"SELECT conv_id, turn, CASE WHEN mode = 'may' AND p >= 0.7 THEN 'must' WHEN mode = 'may' AND p < 0.3 THEN 'not_needed' ELSE mode END AS mode FROM (SELECT *, (conv_id * 7 + turn * 13) % 100 / 100.0::DOUBLE AS p FROM ({_MODES}))")
def p03_recommender(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = policy.recommended(actions(spark, sf_dir), policy.policy_table(spark))
    return r.select("conv_id", "turn", policy.forced(F.col("mode"), (F.col("conv_id") * 7 + F.col("turn") * 13) % 100 / 100.0).alias("mode"))


#: The catalog: for each benchmark item its first two words and its third and fourth.
_PHRASES = r"(SELECT item_id AS concept_id, 0 AS phrase_no, regexp_extract(text, '^(\S+\s+\S+)', 1) AS phrase FROM benchmark UNION ALL SELECT item_id, 1, regexp_extract(text, '^\S+\s+\S+\s+(\S+\s+\S+)', 1) FROM benchmark)"


@query(f"""WITH ph AS (SELECT concept_id, phrase_no, {link_sql('phrase')} AS ts FROM {_PHRASES}), t AS (SELECT concept_id, phrase_no, len(ts) AS n, unnest(ts) AS token FROM ph), tot AS (SELECT count(DISTINCT item_id) AS total FROM benchmark),
idf AS (SELECT token, ln(1 + total / count(DISTINCT concept_id)::DOUBLE) AS idf FROM t, tot GROUP BY token, total), w AS (SELECT doc_id AS text_id, unnest({link_sql('text')}) AS token FROM documents),
h AS (SELECT text_id, concept_id, phrase_no, n, count(*) AS matched, sum(idf) AS idf FROM w JOIN t USING (token) JOIN idf USING (token) GROUP BY ALL HAVING count(*) * 2 >= n),
s AS (SELECT *, round(idf * CASE WHEN matched = n THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END, 3) AS score, matched = n AND (n > 1 OR idf >= 2.5) AS fl FROM h),
b AS (SELECT text_id, concept_id, score, fl FROM s QUALIFY row_number() OVER (PARTITION BY text_id, concept_id ORDER BY score DESC, phrase_no) = 1), r AS (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY score DESC, concept_id) AS rank FROM b QUALIFY rank <= 8),
f AS (SELECT *, max(CASE WHEN fl AND score >= 3.0 THEN score END) OVER (PARTITION BY text_id) AS first FROM r), k AS (SELECT *, coalesce(fl AND score >= 3.0 AND score >= 0.6::DOUBLE * first, false) AS ok FROM f)
SELECT text_id, concept_id, rank, score, fl AS "full", ok AND sum(ok::INT) OVER (PARTITION BY text_id ORDER BY rank) <= 2 AS selected FROM k""")
def p04_p06_concept_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    phrase = lambda n, p: b.select(F.col("item_id").alias("concept_id"), F.lit(n).alias("phrase_no"), F.regexp_extract("text", p, 1).alias("phrase"))
    phrases = phrase(0, r"^(\S+\s+\S+)").unionByName(phrase(1, r"^\S+\s+\S+\s+(\S+\s+\S+)"))
    return policy.linked(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), F.col("text").alias("body")), phrases)
