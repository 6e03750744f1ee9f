"""Checks of typed answers against a target: derivative, antiderivative or value.

Texts are normalised by column functions. Each distinct (kind, target, answer) is read and compared once, in Arrow batches that Spark deals out, and joined back
to the answers, so that what many students write costs no more than what one writes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import algebra

_SCHEMA = "kind string, target string, said string, status string, reason string, missing_constant boolean"


def normalised(text: Column) -> Column:
    """Plain math: markup, superscripts and signs in one notation, and of equations the right side of the last =."""
    out = F.regexp_replace(text, r"\$|\\left|\\right|\\,", "")
    for _ in range(3):  # from the inside outwards
        out = F.regexp_replace(out, r"\\frac\{([^{}]*)\}\{([^{}]*)\}", "(($1)/($2))")
        out = F.regexp_replace(F.regexp_replace(out, r"\\sqrt\{([^{}]*)\}", "sqrt($1)"), r"\^\{([^{}]*)\}", "^($1)")
    out = F.regexp_replace(F.regexp_replace(out, r"\\(cdot|times)", "*"), r"\\([a-z]+)", "$1")
    for sign, plain in (("²", "^2"), ("³", "^3"), ("π", "pi"), ("√", "sqrt"), ("**", "^")):
        out = F.replace(out, F.lit(sign), F.lit(plain))
    return F.trim(F.element_at(F.split(F.translate(out, "−×·", "-**"), "="), -1))


def judged(kind: str, target: str, said: str | None) -> tuple[str, str | None, bool]:
    """(status, method or reason, missing_constant) of one answer; the kind `expression` compares with the target as it stands."""
    if kind not in ("derivative", "antiderivative", "value", "expression") or not target:
        return "unknown", "no_answer_check", False
    if not said:
        return "absent", None, False
    seed = zlib.crc32(f"{kind} {target}".encode())
    try:
        answer = algebra.read(said)
    except algebra.Unread as e:
        words = re.fullmatch(r"[A-Za-z][A-Za-z' ]*", said) and re.search(r"[A-Za-z]{3}", said)
        return "unknown", "non_math_text" if words and str(e) == "parse_failed" else str(e), False
    wanted, missing = algebra.read(target), False
    if kind == "derivative":
        wanted = algebra.slope(wanted)
    elif kind == "antiderivative":
        missing = not algebra.uses(answer, ("const", "C"))
        answer = algebra.slope(answer)
    elif kind == "value" and algebra.uses(answer, ("var",)):
        return "incorrect", "numeric_rejection", False
    elif kind == "value":
        mine, goal = algebra.constant(answer), algebra.constant(wanted)
        if mine is None or mine != mine or goal is None:
            return "unknown", "parse_failed", False
        if decimal := re.fullmatch(r"-?\d*\.(\d+)", said):
            places = len(decimal[1])
            if abs(mine - goal) > 0.5 * 10**-places * (1 + 1e-9):
                return "incorrect", "numeric_rejection", False
            exact = places >= 2 or goal == int(goal)
            return ("correct", "rounded", False) if exact else ("unknown", "low_precision", False)
    status, reason = algebra.compared(answer, wanted, seed)
    return status, reason, missing and status == "correct"


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kind, target, said = (c.to_pylist() for c in batch.columns)
        found = list(zip(*[judged(k, t, s) for k, t, s in zip(kind, target, said, strict=True)], strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found[0], pa.string()), pa.array(found[1], pa.string()), pa.array(found[2], pa.bool_())], ["kind", "target", "said", "status", "reason", "missing_constant"])


def checked(answers: DataFrame) -> DataFrame:
    """answers (kind, target, answer, ...) with status, reason and missing_constant.

    A null answer is absent; a null kind or target has nothing to check against. Repeated answers get the same result.
    """
    asked = answers.withColumn("_said", F.coalesce(normalised(F.col("answer")), F.lit(""))).withColumn("_kind", F.coalesce("kind", F.lit(""))).withColumn("_target", F.coalesce(normalised(F.col("target")), F.lit("")))
    each = asked.select(F.col("_kind").alias("kind"), F.col("_target").alias("target"), F.col("_said").alias("said")).distinct()
    known = each.mapInArrow(_batches, _SCHEMA)
    known = known.select(*[F.col(c).alias(f"_{c}") for c in ("kind", "target", "said")], "status", "reason", "missing_constant")
    return asked.join(known, ["_kind", "_target", "_said"]).drop("_kind", "_target", "_said")


def leaks(replies: DataFrame, withheld: DataFrame, written: DataFrame) -> DataFrame:
    """(reply_id, check): what replies (reply_id, reply) give away of withheld (reply_id, check, kind, target).

    Every part between dollars that is one expression and doesn't set the variable is checked, of equations their right side. It leaks if it is right, or might be
    (an equality that is neither proved nor rejected), unless the student wrote an equal expression before: written (reply_id, said).
    """
    parts = F.regexp_extract_all("reply", F.lit(r"\$([^$]+)\$"), F.lit(1))
    segments = replies.select("reply_id", F.explode(F.array_distinct(parts)).alias("answer")).where(~F.col("answer").rlike(r"^\s*x\s*=|[\[\],;]"))
    given = checked(segments.join(withheld, "reply_id"))
    given = given.where((F.col("status") == "correct") | F.coalesce(F.col("reason") == "equivalence_unproven", F.lit(False)))
    own = checked(segments.join(written.select("reply_id", F.col("said").alias("target")), "reply_id").withColumn("kind", F.lit("expression"))).where("status = 'correct'")
    return given.join(own.select("reply_id", "answer"), ["reply_id", "answer"], "left_anti").select("reply_id", "check").distinct()
