"""Ports for what lies outside the engine: encoders, judges, text models, recognisers. The doubles here are deterministic."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import text


def encoder(encode: Callable[[list[str]], np.ndarray] | None = None, prompt: str = "", dim: int = 64) -> Callable[[Column], Column]:
    """Texts to vectors; the model is made once for each worker. The default hashes words."""

    def hashed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = 1469598103934665603
                for b in w.encode():
                    h = (h ^ b) * 1099511628211 % (1 << 64)
                out[i, h % dim] += 1.0 if h >> 63 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = encode or hashed
        for s in batches:
            yield pd.Series(list(f([prompt + (x or "") for x in s])))

    return run


def overlap_judge(need: Column, body: Column) -> Column:
    """The default judge: the share of the need's terms that the passage holds."""
    a, b = F.array_distinct(text.evidence_terms(need)), text.evidence_terms(body)
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(F.lit(0.0))


@F.pandas_udf(T.StringType())
def adhoc_suffix(s: pd.Series) -> pd.Series:
    """First eight hex digits of SHA-1 over the text in NFKC, lower case, without white space."""
    import hashlib

    return s.map(lambda x: None if x is None else hashlib.sha1("".join(unicodedata.normalize("NFKC", x).lower().split()).encode()).hexdigest()[:8])


def first_object(answer: str | None) -> str | None:
    """The first balanced JSON object of a model's answer, past its thoughts and fences; null if there is none."""
    if not answer:
        return None
    body = answer.rpartition("</think>")[2]
    at = body.find("{")
    while at >= 0:
        try:
            value, _ = json.JSONDecoder().raw_decode(body, at)
            return json.dumps(value, ensure_ascii=False)
        except json.JSONDecodeError:
            at = body.find("{", at + 1)
    return None


@F.pandas_udf(T.StringType())
def json_object(s: pd.Series) -> pd.Series:
    return s.map(first_object)


def local_reply(action: Column, heading: Column) -> Column:
    """A sentence for an action where no text model is set."""
    where = F.when(heading.isNotNull(), F.concat(F.lit(" See "), heading, F.lit("."))).otherwise(F.lit(""))
    lead = (
        F.when(action == "hint", "Here is a hint to begin with.").when(action == "explain", "Let us go through the idea.").when(action == "probe", "What have you tried so far?")
        .when(action == "clarify", "Which part do you mean?").when(action == "confirm", "That is right.").when(action == "retry", "Look at this step once more.").otherwise("Go on with the next step.")
    )
    return F.concat(lead, where)
