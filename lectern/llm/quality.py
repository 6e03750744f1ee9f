"""Quality rules: fixed limits, then robust multivariate outliers within each language and source.

A document's statistics are shares and densities made symmetric with even variance. Their centre and scatter come from a
minimum-covariance-determinant estimate. Three deterministic starts (all rows; medians and median deviations; a hashed eighth of the rows) take two
concentration steps each, which refit centre and scatter on the `SUPPORT` share of rows that lie nearest; from the one with the least determinant, steps
go on until no group's determinant falls any more. The scatter is multiplied by the consistency factor of the support share under a normal
distribution, and the variance that counts of short texts have anyhow is added to it, as regularised estimates do, so no scatter is singular. Rows
beyond the normal distribution's `TAIL` are rejected.

A step is one aggregation: moments are summed by group and distance cell, so what reaches a task is bounded by the number of cells, however many
rows a group has. Texts are measured once; the steps read the few numbers of each row.

Nulls and edge cases: a null or empty text has no words and fails the base rules; null lang or source form groups of
their own; groups under `least` rows are pooled; repeated rows are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HashedWords, dropped, fresh, octets, released, staged

WINDOW = 5
#: Entries of the statistic vector.
STATS = ("v0", "v1", "v2", "v3", "v4")
#: Share of a group that the estimate rests on, distance cells, steps of every start.
SUPPORT, CELLS, FIRST_STEPS = 0.75, 512, 2
#: Groups with fewer rows than this take the estimate of all such groups together.
LEAST = 60
#: Share of a normal bulk that lies beyond the limit.
TAIL = 1e-6
#: Standard deviations that the statistics have from counting alone; their squares are added to the variances.
FLOORS = (0.05, 0.03, 0.15, 0.12, 0.04)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_COUNTS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, v0 double, v1 double, v2 double, v3 double, v4 double"
_SYMBOLS = b"#*$%&|<>"
_ASCII_UPPER = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))


def repeated_words(h: np.ndarray, k: int = WINDOW) -> int:
    """Words covered by k-word windows that occur twice or more."""
    n = len(h) - k + 1
    if n < 2:
        return 0
    g = h[:n].copy()
    for j in range(1, k):
        g *= _MULT
        g += h[j : j + n]
    order = np.argsort(g)
    s = g[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(h) + 1, np.int32)
    edge[:n] += twice
    edge[k : k + n] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measured(t: bytes | None, hashed: HashedWords) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the statistic vector of one text."""
    t = t or b""
    words = t.split()
    n = len(words)
    bare = b"".join(words)
    chars = len(bare) - (len(bare) - len(bare.translate(None, _CONTINUED)))
    symbols = len(t) - len(t.translate(None, _SYMBOLS))
    lines = [x for x in t.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(hashed.of(words))
    upper = len(bare) - len(bare.translate(None, _ASCII_UPPER))
    share = lambda a, b: float(np.arcsin(np.sqrt(min(1.0, a / max(1.0, b)))))  # noqa: E731  its variance does not follow the share
    # a short text is drawn towards what is usual: added words of five letters, added lines and letters without a finding
    return n, chars, symbols, dup, repeat, float(np.log((chars + 100.0) / (n + 20.0))), share(symbols, chars + 60), share(dup, len(lines) + 8), share(repeat, n + 40), share(upper, chars + 60)


def counted(docs: DataFrame) -> DataFrame:
    """The statistics of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = HashedWords()
        for batch in batches:
            rows = [measured(t, hashed) for t in octets(batch.column(3))]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 10
            arrays = [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()), batch.column(2).cast(pa.string()), *(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.float64()) for c in cols[5:])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *STATS])

    return docs.select("doc_id", "lang", "source", "text").mapInArrow(released(run), _COUNTS)


def chi2_below(x: float, d: int) -> float:
    """P(chi-square of d degrees <= x), by the series of the incomplete gamma function."""
    a, y = d / 2, x / 2
    term = total = 1.0 / a
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= y / (a + n)
        total += term
    return total * math.exp(a * math.log(y) - y - math.lgamma(a)) if x > 0 else 0.0


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1.0
    while chi2_below(high, d) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_below(mid, d) < p else (low, mid)
    return high


def consistency(support: float, d: int) -> float:
    """What the scatter of the nearest `support` share of a normal sample is to be multiplied by."""
    return support / chi2_below(chi2_quantile(support, d), d + 2)


#: Mahalanobis distance beyond which a document goes.
LIMIT = math.sqrt(chi2_quantile(1 - TAIL, len(STATS)))


def _fit(pdf: pd.DataFrame, support: float, d: int) -> pd.DataFrame:
    """Centre, inverse scatter and log determinant of the nearest `support` share; cells hold moments, in the order of distance."""
    pdf = pdf.sort_values("cell")
    total = pdf["n"].sum()
    inner = pdf[(pdf["n"].cumsum() - pdf["n"]) < support * total]
    n = float(inner["n"].sum())
    mean = np.array([inner[f"s{i}"].sum() for i in range(d)]) / n
    cov = np.zeros((d, d))
    for i in range(d):
        for j in range(i, d):
            cov[i, j] = cov[j, i] = inner[f"s{i}_{j}"].sum() / n - mean[i] * mean[j]
    cov[np.diag_indices(d)] = np.maximum(cov[np.diag_indices(d)], 0)
    cov = cov * (consistency(support, d) if support < 1 else 1.0) + np.diag(np.square(FLOORS[:d]))
    return pd.DataFrame([[pdf["g"].iloc[0], pdf["start"].iloc[0], list(map(float, mean)), list(map(float, np.linalg.inv(cov).ravel())), float(np.linalg.slogdet(cov)[1])]], columns=["g", "start", "mean", "inverse", "volume"])


def _group() -> Column:
    return F.concat_ws("\x01", F.coalesce("lang", F.lit("\x02")), F.coalesce("source", F.lit("\x02")))


def _medians(rows: DataFrame) -> DataFrame:
    """A start from medians and median deviations (approximate, to a hundredth of a percent of ranks)."""
    d = len(STATS)
    middle = rows.groupBy("g").agg(*[F.percentile_approx(v, 0.5, 10000).alias(f"m{i}") for i, v in enumerate(STATS)])
    spread = rows.join(middle, "g").groupBy("g").agg(*[F.first(f"m{i}").alias(f"m{i}") for i in range(d)], *[F.percentile_approx(F.abs(F.col(v) - F.col(f"m{i}")), 0.5, 10000).alias(f"d{i}") for i, v in enumerate(STATS)])
    variance = [F.pow(F.col(f"d{i}") * 1.4826, F.lit(2.0)) + F.lit(FLOORS[i] ** 2) for i in range(d)]
    inverse = F.array(*[1 / variance[i] if i == j else F.lit(0.0) for i in range(d) for j in range(d)])
    return spread.select("g", F.lit(1).alias("start"), F.array(*[F.col(f"m{i}") for i in range(d)]).alias("mean"), inverse.alias("inverse"), F.lit(0.0).alias("volume"))


def fitted(rows: DataFrame, support: float = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """The rows with their pool `g`, and the estimate (g, mean, inverse) of every pool: a language and source, or all small ones."""
    d = len(STATS)
    rows = staged(rows.withColumn("_group", _group()), "vectors")
    sizes = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"))
    pools = staged(sizes.select("_group", F.when(F.col("_n") < LEAST, F.lit("\x03")).otherwise(F.col("_group")).alias("g")), "pools")
    rows = rows.join(pools, "_group")
    vectors = staged(rows.select("g", *STATS, F.xxhash64("doc_id", *STATS).alias("_h")), "vectors")
    x = [F.col(v) for v in STATS]
    sums = [F.count(F.lit(1)).alias("n"), *(F.sum(x[i]).alias(f"s{i}") for i in range(d)), *(F.sum(x[i] * x[j]).alias(f"s{i}_{j}") for i in range(d) for j in range(i, d))]
    cell = F.least(F.lit(CELLS - 1), F.floor(F.log2(1 + F.col("d2") * 4) * 32)).cast("int")

    def estimate(cells: DataFrame, share: float) -> DataFrame:
        of = cells.groupBy("g", "start", "cell").agg(*sums).groupBy("g", "start")
        return of.applyInPandas(lambda p: _fit(p, share, d), "g string, start int, mean array<double>, inverse array<double>, volume double")

    step = lambda fit: staged(estimate(far(vectors, fit).withColumn("cell", cell), support), "fit")
    whole = lambda part, start: estimate(part.withColumn("start", F.lit(start)).withColumn("cell", F.lit(0)), 1.0)
    fit = staged(whole(vectors, 0).unionByName(_medians(vectors)).unionByName(whole(vectors.where(F.pmod("_h", F.lit(8)) == 0), 2)), "fit")
    for _ in range(FIRST_STEPS):
        fit = step(fit)
    least = lambda df: df.groupBy("g").agg(F.min_by(F.struct("start", "mean", "inverse", "volume"), F.struct("volume", "start")).alias("f")).select("g", "f.*")
    fit = staged(least(fit), "fit")
    while True:
        new = step(fit)
        both = fit.join(new.select("g", F.struct("start", "mean", "inverse", "volume").alias("new")), "g").withColumn("fell", F.col("new")["volume"] < F.col("volume") - 1e-9)
        both = staged(both.select("g", "fell", *[F.when(F.col("fell"), F.col("new")[c]).otherwise(F.col(c)).alias(c) for c in ("start", "mean", "inverse", "volume")]), "fit")
        dropped(fit, new)
        fit = both.drop("fell")
        if not both.where("fell").limit(1).count():
            break
    dropped(vectors)
    return rows, fit.select("g", "mean", "inverse")


def far(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance from the pool's estimate."""
    d = len(STATS)
    diff = [F.col(STATS[i]) - F.col("mean")[i] for i in range(d)]
    square = sum((diff[i] * diff[j] * F.col("inverse")[i * d + j] for i in range(d) for j in range(d)), F.lit(0.0))
    return rows.join(fit, "g").withColumn("d2", F.greatest(square, F.lit(0.0))).drop("mean", "inverse")


def judged(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """The statistics with base_failed, distance and kept."""
    rows, fit = fitted(counted(docs))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = far(rows, fit).withColumn("distance", F.sqrt("d2")).drop("_group", "g", "d2")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("distance") <= limit))


def filtered(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """The rows of docs that the rules keep, all columns. The estimates, a row for each group, go to the texts; texts aren't moved."""
    rows, fit = fitted(counted(docs))
    centre, scatter, name = fresh(docs.columns, "mean", "inverse", "group")
    of_group = staged(rows.select("_group", "g").distinct().join(fit, "g").select(F.col("_group").alias(name), F.col("mean").alias(centre), F.col("inverse").alias(scatter)), "fit")
    columns, text = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = HashedWords()
        for batch in batches:
            keep = []
            for t, mean, inverse in zip(octets(batch.column(text)), batch.column(centre).to_pylist(), batch.column(scatter).to_pylist(), strict=True):
                n, _, _, _, repeat, *v = measured(t, hashed)
                diff = np.asarray(v) - mean
                keep.append(n >= 10 and 100 * repeat <= 20 * n and diff @ np.reshape(inverse, (len(v), len(v))) @ diff <= limit * limit)
            yield batch.select(columns).filter(pa.array(keep, pa.bool_()))

    joined = docs.join(of_group, _group() == F.col(name)).select(*[docs[f"`{c}`"] for c in columns], centre, scatter)
    return joined.mapInArrow(released(run), docs.schema)
