"""The math check over answers derived from the turns of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mathcheck
from .base import query, table


@query("""WITH t AS (SELECT conv_id, turn, (length(text) % 7 + 2) AS a, (turn % 4 + 2) AS k, (conv_id % 3) AS kind, (conv_id + turn) % 3 <> 0 AS ok, turn % 2 = 1 AS bare FROM conversations)
SELECT conv_id, turn, CASE kind WHEN 0 THEN 'derivative' WHEN 1 THEN 'antiderivative' ELSE 'value' END AS kind, CASE WHEN ok THEN 'correct' ELSE 'incorrect' END AS status,
CASE WHEN ok THEN 'symbolic' ELSE 'numeric_rejection' END AS reason, kind = 1 AND ok AND bare AS missing_constant FROM t""")
def z08_math_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn asks for one of three checks, with numbers of the turn; a third of the answers is off by one, and odd turns leave the constant out."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") % 7 + 2).alias("a"), (F.col("turn") % 4 + 2).alias("k"), ((F.col("conv_id") + F.col("turn")) % 3 == 0).cast("int").alias("off"))
    kind = F.element_at(F.array(F.lit("derivative"), F.lit("antiderivative"), F.lit("value")), (F.col("conv_id") % 3 + 1).cast("int"))
    said = lambda form, *columns: F.format_string(form, *columns)
    ak = F.col("a") * F.col("k")
    target = F.when(kind == "derivative", said("%1$d x^%2$d + sin(%1$dx) cos(%1$dx)", "a", "k")).when(kind == "antiderivative", said("%dx^{%d} + e^{x/%d}", ak, F.col("k") - 1, "a")).otherwise(said("\\frac{%d}{%d} + pi", "a", "k"))
    answer = F.when(kind == "derivative", said("y' = %dx^%d + %d cos(%dx)", ak + F.col("off"), F.col("k") - 1, "a", 2 * F.col("a")))
    constant = F.when(F.col("turn") % 2 == 0, F.lit(" + C")).otherwise(F.lit(""))
    answer = answer.when(kind == "antiderivative", F.concat(said("%dx^%d + %d exp(x/%d)", F.col("a") + F.col("off"), "k", "a", "a"), constant)).otherwise(said("(%d + %d·π)/%d", F.col("a") + F.col("off"), "k", "k"))
    asked = t.select("conv_id", "turn", kind.alias("kind"), target.alias("target"), answer.alias("answer"))
    return mathcheck.checked(asked).select("conv_id", "turn", "kind", "status", "reason", "missing_constant")


@query("""WITH t AS (SELECT conv_id * 1000 + turn AS reply_id, length(text) % 7 + 2 AS a, turn % 4 AS form, (conv_id + turn) % 3 = 0 AS knew FROM conversations WHERE role = 'assistant')
SELECT reply_id, 'final_answer' AS "check" FROM t WHERE form = 0 AND NOT knew UNION ALL SELECT reply_id, 'key_expression' FROM t WHERE form = 1""")
def z07_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that show the answer or a key step in other words than the problem's, give a wrong one, set the variable, or repeat what the student wrote."""
    t = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    t = t.select((F.col("conv_id") * 1000 + F.col("turn")).alias("reply_id"), "conv_id", "turn", (F.length("text") % 7 + 2).alias("a"))
    said = lambda form, *columns: F.format_string(form, *columns)
    form = F.col("turn") % 4
    reply = F.when(form == 0, said("Then $y' = x \\cdot %d$ follows.", 2 * F.col("a"))).when(form == 1, said("Look at $(x+%1$d)^2 - x^2 - %2$d$ first.", "a", F.col("a") * F.col("a")))
    reply = reply.when(form == 2, said("Put $x = %d$ in, not $%dx^2$.", "a", "a")).otherwise(said("It lies in $[%d, 9]$.", "a"))
    replies = t.select("reply_id", reply.alias("reply"))
    answer = t.select("reply_id", F.lit("final_answer").alias("check"), F.lit("derivative").alias("kind"), said("%dx^2 + 7", "a").alias("target"))
    step = t.select("reply_id", F.lit("key_expression").alias("check"), F.lit("expression").alias("kind"), said("%dx + 0", 2 * F.col("a")).alias("target")).where("reply_id % 1000 % 4 = 1")
    withheld = answer.where("reply_id % 1000 % 4 <> 1").unionByName(step)
    written = t.where((F.col("conv_id") + F.col("turn")) % 3 == 0).where("turn % 4 <> 1").select("reply_id", said("%dx + %dx", "a", "a").alias("said"))
    return mathcheck.leaks(replies, withheld, written)
