"""Line deduplication by a suffix array over line-id sequences, built by distributed prefix doubling.

Ranks of single lines become ranks of runs of 2, 3 and 4 lines and are then doubled to 8, 16, ... lines until no run is found twice: the rank of
a run is its place among all runs of that length, by (rank of its first part, rank of its second part). Suffixes of one rank are an interval of
the suffix array whose longest common prefix has that many lines or more. The interval's earliest suffix stays; every later one shares so many lines
with it, and the longest length for which that holds is kept for each suffix. These prefixes, joined where they meet or overlap in a document, are the
maximal repeated runs, and their lines go.

A run counts if it has `min_lines` lines, or if its lines have `min_words` words together (with `whole_runs`; without, only single lines of
`min_words` words count below `min_lines`). Lengths below four are judged one by one, as a run of two or three lines may have the words that a shorter
one lacks; beyond, every power of two, which cover each longer run by overlap. Only lines found more than once take part: a unique line ends every run.

Nulls and edge cases: lines are split at \\n and told apart by 128-bit hashes; lines without words take part in runs but are never removed on their own; a
null text stays null, without lines. Rows equal in doc_id and text are one place and get the same result, so they don't remove one another; rows with one
doc_id and different texts are documents of their own, in the order of a hash of their texts. A row without doc_id is left as it is and is no earlier copy
of another. An empty table gives an empty result; other columns are kept as they are, but n_lines and n_removed of `deduplicated` take the place of columns so
named (`cut` keeps the rows apart).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, exact_rank, fresh, keyed, octets, released, staged

MIN_LINES, MIN_WORDS = 4, 15


def hashed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, one, two, words) for every line of docs (doc_id, text), no doc_id twice: one and two are 128 bits of hash of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pos, digests, words = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), octets(batch.column(1)), strict=True):
                if text is None:
                    continue
                parts = text.split(b"\n")
                ids += [doc] * len(parts)
                pos += range(len(parts))
                digests += map(xxhash.xxh3_128_digest, parts)
                words += [min(len(x.split()), 1 << 20) for x in parts]
            hashes = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pos, pa.int32()), pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy()), pa.array(words, pa.int32())], ["doc_id", "pos", "one", "two", "words"])

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, pos int, one long, two long, words int")


def ranked(lines: DataFrame) -> DataFrame:
    """(doc_id, pos, rank, words, last) of the lines found more than once.

    The repeated lines are written before they meet all lines again, so that Spark may split the join at a line that very many texts have.
    """
    found = lines.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("_all", F.lit(0))
    ranks = staged(exact_rank(found, ["_all"], F.shiftright("one", 52), [F.col("one"), F.col("two")], "rank", "n").select("one", "two", "rank"), "ranks")
    return staged(lines.join(ranks, ["one", "two"]).select("doc_id", "pos", "rank", "words", F.col("words").alias("last")), "runs")


def doubled(runs: DataFrame, shift: int) -> DataFrame:
    """Ranks of runs `shift` lines longer, where that is no more than they have; runs that meet a unique line or the end, or are found once, go.

    `last` has the words of a run's last `shift` lines, where that is 1, and `words` those of the whole run.
    """
    ahead = runs.select("doc_id", (F.col("pos") - shift).alias("pos"), F.col("rank").alias("next"), F.col("last").alias("more"))
    pairs = runs.join(ahead, ["doc_id", "pos"]).select("doc_id", "pos", "rank", "next", F.least(F.col("words") + F.col("more"), F.lit(1 << 20)).alias("words"), F.col("more").alias("last"))
    pairs = staged(pairs, "pairs")
    distinct = pairs.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # within one first half, by the second: the halves' ranks are cut into buckets, so a very frequent first half is dealt out
    below = staged(exact_rank(distinct, ["rank"], F.shiftright("next", 12), [F.col("next")], "below", "n").select("rank", "next", (F.col("rank") + F.col("below")).alias("new")), "ranks")
    out = staged(pairs.join(below, ["rank", "next"]).select("doc_id", "pos", F.col("new").alias("rank"), "words", "last"), "runs")
    dropped(pairs, below)
    return out


def _later(runs: DataFrame, length: int, least: int = 0) -> DataFrame:
    """(doc_id, pos, length) of every run with `least` words that isn't the earliest of its interval."""
    runs = runs.where(F.col("words") >= least)  # runs of one rank have the same words
    first = staged(runs.groupBy("rank").agg(F.min(F.struct("doc_id", "pos")).alias("first")), "firsts")
    return runs.join(first, "rank").where(F.struct("doc_id", "pos") > F.col("first")).select("doc_id", "pos", F.lit(length).alias("length"))


def repeated_prefixes(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, whole_runs: bool = False) -> DataFrame:
    """(doc_id, pos, length) for docs (doc_id, text), no doc_id twice: for every place, the most lines for which a run that counts starts there and earlier, too."""
    lines = staged(hashed_lines(docs), "lines")
    runs = ranked(lines)
    dropped(lines)
    found, length = [staged(_later(runs, 1, min_words if min_lines > 1 else 0), "later")], 1
    while True:
        shift = (1 if whole_runs else min(length, min_lines - length)) if length < min_lines else length
        new = doubled(runs, shift)
        dropped(runs)
        runs, length = new, length + shift
        if not runs.limit(1).count():
            break
        if length >= min_lines or whole_runs:
            found.append(staged(_later(runs, length, 0 if length >= min_lines else min_words), "later"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return staged(out.groupBy("doc_id", "pos").agg(F.max("length").alias("length")), "prefixes")


def maximal_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows (start, end) of the runs that prefixes of one document make up together."""
    order = np.argsort(starts, kind="stable")
    begin, end = starts[order].astype(np.int64), np.maximum.accumulate((starts + lengths)[order].astype(np.int64)) if len(starts) else np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]])) if len(begin) else np.zeros(0, np.int64)
    return np.stack([begin[at], end[np.append(at[1:], len(end)) - 1]], 1) if len(at) else np.zeros((0, 2), np.int64)


def _n_lines(text: Column) -> Column:
    return F.coalesce(F.char_length(text) - F.char_length(F.translate(text, "\n", "")) + 1, F.lit(0)).cast("long")


def cut(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, whole_runs: bool = False) -> DataFrame:
    """(row, text, n_lines, n_removed): every row of docs as one value, its text without the later copies of repeated runs, and the counts."""
    (key,) = fresh(docs.columns, "_key")
    rows, places = keyed(docs.where("doc_id IS NOT NULL"), key)
    prefixes = repeated_prefixes(places, min_lines, min_words, whole_runs).groupBy(F.col("doc_id").alias("id")).agg(F.collect_list("pos").alias("pos"), F.collect_list("length").alias("length"))

    @F.pandas_udf("struct<text:string,gone:long>")
    def without(text: pd.Series, pos: pd.Series, length: pd.Series) -> pd.DataFrame:
        texts, gone = [], []
        for t, p, n in zip(text, pos, length, strict=True):
            if t is None or p is None:
                texts.append(None)
                gone.append(0)
                continue
            parts, keep, total = t.split("\n"), [], 0
            at = 0
            for begin, end in np.minimum(maximal_runs(np.asarray(p), np.asarray(n)), len(parts)).tolist():
                keep += parts[at:begin]
                total += end - begin
                at = end
            texts.append("\n".join([*keep, *parts[at:]]))
            gone.append(total)
        return pd.DataFrame({"text": texts, "gone": gone})

    whole = lambda df, id: df.select(id.alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = whole(rows, F.col(key)).unionByName(whole(docs.where("doc_id IS NULL"), F.lit(None).cast("long")))
    joined = rows.join(prefixes.hint("merge"), "id", "left")  # the same plan at every size
    text = F.col("row")["text"]
    made = joined.select("row", "pos", without(F.when(F.col("pos").isNotNull(), text), "pos", "length").alias("made"))
    return made.select("row", F.when(F.col("pos").isNull(), text).otherwise(F.col("made")["text"]).alias("text"), _n_lines(text).alias("n_lines"), F.coalesce(F.col("made")["gone"], F.lit(0)).alias("n_removed"))


def deduplicated(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, whole_runs: bool = False) -> DataFrame:
    """docs with the later copies of repeated runs deleted from `text`, and the counts n_lines, n_removed."""
    out = cut(docs, min_lines, min_words, whole_runs)
    others = [F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return out.select(*others, "n_lines", "n_removed")
