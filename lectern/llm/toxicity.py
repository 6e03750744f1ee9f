"""Toxicity by non-negative positive-unlabelled learning.

The classifier knows confirmed toxic texts and unlabelled ones. Its risk is
    prior * R(positives as positive) + max(0, R(unlabelled as negative) - prior * R(positives as negative)),
the class-prior-corrected estimate whose negative part is kept from falling below zero: where it would, the step
goes against it, so that the model does not fit unlabelled toxic texts as harmless. Confirmed texts are a bounded sample (`SAMPLE`) of the rows
labelled toxic; the unlabelled ones are a bounded sample (`UNLABELLED`) of all rows of the label table, with the label left out; the class prior
is the toxic share of all these rows. Held-out rows take no part. Features are the presence of hashed words and beginnings of words, those whose count
among the confirmed texts the unlabelled ones don't explain at the 5 % level after correction for all places tested. The weights are trained in numpy;
scale and shift of the score are then fitted under the same risk without weight decay. Every whole text is scored where it lies.

Nulls and edge cases: null and empty texts have no features and get the bias' score; without confirmed toxic
texts every score is 0; repeated rows are scored each; null labels are no labels, and a row labelled both ways is toxic; other
columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import octets

#: Hash places; words kept as features; confirmed and unlabelled texts that training takes at most (about), chosen by a hash of doc_id.
PLACES, FEATURES, SAMPLE, UNLABELLED = 1 << 20, 4096, 8000, 16000
EPOCHS, RATE, DECAY = 300, 0.05, 1e-3
#: Chance that any word passes as a feature without need; words of more bytes are hashed anew each time.
LEVEL, LONGEST = 0.05, 256
#: Lengths in bytes of the beginnings of words that are features too.
BEGINNINGS = (4, 5, 6)
_SPACED = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


class Places(dict):
    """word -> the hash places of the word and of its beginnings, which inflected forms share."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= 400_000:
            self.clear()
        parts = (word, *(b"^" + word[:n] for n in BEGINNINGS if len(word) >= n))
        h = tuple(xxhash.xxh3_64_intdigest(p, 5) % PLACES for p in parts)
        if len(word) <= LONGEST:
            self[word] = h
        return h


def placed(text: bytes | None, places: Places) -> np.ndarray:
    """Sorted distinct hash places of a text's words (letters and digits, lower-cased)."""
    words = set((text or b"").translate(_SPACED).split())
    return np.unique(np.fromiter(itertools.chain.from_iterable(map(places.__getitem__, words)), np.int32))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


@dataclass
class Model:
    weights: np.ndarray  # by hash place
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def score(self, text: bytes | None, places: Places) -> float:
        z = self.scale * (float(self.weights[placed(text, places)].sum()) + self.bias) + self.shift
        return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The non-negative risk with the logistic loss, and the direction to descend by the scores of confirmed and unlabelled texts.

    That is the gradient where the negative part is not below zero, and the negative part's gradient turned round where it is.
    """
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    positive = prior * np.logaddexp(0, -zp).mean()
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    gp, gu = -prior * sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
    if negative < 0:
        return positive, -gp, -gu
    return positive + negative, gp - prior * sigmoid(-zp) / len(zp), gu


def descended(start: np.ndarray, gradient, steps: int = EPOCHS, rate: float = RATE) -> np.ndarray:
    """Adam."""
    x, m, v = start.copy(), np.zeros(len(start)), np.zeros(len(start))
    for step in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return x


def features(pos: list[np.ndarray], unl: list[np.ndarray]) -> np.ndarray:
    """Places found in more confirmed texts than the unlabelled ones let expect."""
    seen = [np.bincount(np.concatenate(x), minlength=PLACES) for x in (pos, unl)]
    expected = (seen[1] + 0.5) / len(unl) * len(pos)
    tested = (seen[0] >= 3) & (seen[0] > expected)
    # twice the log-likelihood ratio; its tail at x is below exp(-x / 2)
    gain = np.where(tested, 2 * (seen[0] * np.log(np.maximum(seen[0], 1) / expected) - (seen[0] - expected)), 0.0)
    chosen = np.argsort(-gain, kind="stable")[:FEATURES]
    return chosen[gain[chosen] >= 2 * np.log(max(1, (seen[0] > 0).sum()) / LEVEL)]


def nnpu(pos: list[np.ndarray], unl: list[np.ndarray], prior: float) -> Model:
    """Weights that lower the non-negative risk with weight decay; then scale and shift that lower it without."""
    chosen = features(pos, unl)
    d = len(chosen)
    slot = np.full(PLACES, -1, np.int32)
    slot[chosen] = np.arange(d)

    def compact(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        cols = [c[c >= 0] for c in (slot[t] for t in texts)]
        return np.repeat(np.arange(len(texts)), [len(c) for c in cols]), np.concatenate(cols) if cols else np.zeros(0, np.int32)

    (pr, pc), (ur, uc) = compact(pos), compact(unl)
    scores = lambda x: (np.bincount(pr, x[:-1][pc], len(pos)) + x[-1], np.bincount(ur, x[:-1][uc], len(unl)) + x[-1])

    def gradient(x: np.ndarray) -> np.ndarray:
        _, gp, gu = risk(*scores(x), prior)
        return np.append(np.bincount(pc, gp[pr], d) + np.bincount(uc, gu[ur], d) + DECAY * x[:-1], gp.sum() + gu.sum())

    x = descended(np.zeros(d + 1), gradient)
    zp, zu = scores(x)

    def outer(a: np.ndarray) -> np.ndarray:
        _, gp, gu = risk(a[0] * zp + a[1], a[0] * zu + a[1], prior)
        return np.array([gp @ zp + gu @ zu, gp.sum() + gu.sum()])

    scale, shift = descended(np.array([1.0, 0.0]), outer)
    weights = np.zeros(PLACES)
    weights[chosen] = x[:-1]
    return Model(weights, float(x[-1]), float(max(scale, 0.1)), float(shift))


def trained(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model from the labels of rows that aren't held out."""
    spark = docs.sparkSession
    known = labels.where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = known.agg(F.count(F.lit(1)), F.sum(F.col("toxic").cast("long"))).first()
    if not toxic:
        return None
    part = lambda seed, most, of: F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, most / max(1, of))) + 1)
    as_confirmed, as_unlabelled = (F.col("toxic") == 1) & part(11, SAMPLE, toxic), part(13, UNLABELLED, n)
    sample = known.select("doc_id", as_confirmed.alias("confirmed"), as_unlabelled.alias("unlabelled")).where("confirmed OR unlabelled")
    chosen = [tuple(r) for r in sample.collect()]  # about SAMPLE + UNLABELLED rows of a number and two flags
    ids = spark.createDataFrame(chosen, "doc_id long, confirmed boolean, unlabelled boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places()
        for batch in batches:
            rows = [placed(t, places).tobytes() for t in octets(batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(rows, pa.binary())], ["confirmed", "unlabelled", "_order", "x"])

    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("confirmed", "unlabelled", F.xxhash64("doc_id").alias("_order"), "text")
    got = picked.mapInArrow(run, "confirmed boolean, unlabelled boolean, _order long, x binary").toPandas().sort_values(["_order", "x"])
    pos, unl = ([np.frombuffer(x, np.int32) for x in got["x"][got[kind]]] for kind in ("confirmed", "unlabelled"))
    return nnpu(pos, unl, min(0.9, max(1e-3, toxic / n))) if pos and unl else None


def scored(docs: DataFrame, model: Model | None, limit: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    spark = docs.sparkSession
    used = np.flatnonzero(model.weights) if model else np.zeros(0, np.int64)
    sent = spark.sparkContext.broadcast((used, model.weights[used], model.bias, model.scale, model.shift) if model else None)  # FEATURES weights at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, m = Places(), None
        if sent.value is not None:
            at, w, *rest = sent.value
            weights = np.zeros(PLACES)
            weights[at] = w
            m = Model(weights, *rest)
        for batch in batches:
            score = [m.score(t, places) if m else 0.0 for t in octets(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(score, pa.float64()), pa.array([int(s >= limit) for s in score], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
