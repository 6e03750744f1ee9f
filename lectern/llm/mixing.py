"""Mixing sources to target weights by entropy balancing.

The base measure takes each document once. Among all mixes whose sources hold the wanted tokens and that take no document
more than `cap` times, the one closest to it in relative entropy gives document i of source s the rate
min(cap, exp(lambda_s * x_i)), where x_i is its token count by the source's scale: documents are tilted one by one, the long ones most.
The lambdas maximise the concave dual; its gradient is the tokens that a source's rates take less its target. Each Newton round sums
gradient and curvature over the whole table, for all sources at once, and moves every lambda inside a bracket that only narrows; it ends when no gradient
exceeds TOLERANCE of its target. Rates depend on (source, token count) alone, so the table is first combined to counts of these, which are exact; no round
runs on the driver, which reads only the largest gradient.

Rates become whole copies by systematic rounding: along the order of size, a document gets one more copy where the running sum of fractions passes a
whole number, so the words taken follow the rates at every length; what then is missing from a source's target is made up by a few
documents of falling size. Sums are taken in whole or decimal numbers, so reruns agree.

Targets: weights by the sources' order (code points, null last), repeating; a target stops at `cap` times its
source's size and what is above is shared again by weight among the rest.

Nulls and edge cases: a null text has no words; a document without words has rate 1 and takes 0 words; a null source is a source of its own; a source
without words has target 0; repeated rows are mixed each, null ids too; an empty table gives an empty result; other columns, whatever their names, are kept
by `mixed`, ignored by `mix`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dropped, exact_rank, staged

WORD_GAPS = r"[\x20\x09-\x0D]+"
#: Documents of each size class and direction that the correction may choose from.
SPARE = 8
#: Gradient of the dual at which Newton's method ends, as a share of the target; the unit of fractions of copies.
TOLERANCE, UNIT = 1e-9, 1 << 20


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and tab to carriage return."""
    return F.coalesce(F.size(F.filter(F.split(text, WORD_GAPS), lambda w: w != "")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Water-filling in one pass: a source is capped when cap * size / weight is small, so in the order of that ratio the
    capped ones come first, and the water level follows from running sums. The table has a row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("_limit", F.col("source_size") * F.lit(float(cap))).withColumn("_ratio", F.col("_limit") / F.col("_w"))
    by_ratio = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    filled = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    s = s.withColumn("_left", F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("_limit").over(filled), F.lit(0.0)))
    s = s.withColumn("_open", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(filled), F.lit(0.0))).withColumn("_level", F.col("_left") / F.col("_open")).withColumn("_at", F.row_number().over(by_ratio))
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_at", "_level"))).over(everything)["_level"]
    return s.withColumn("_water", level).select("source", "source_size", F.least(F.col("_limit"), F.coalesce(F.col("_water"), F.lit(float("inf"))) * F.col("_w")).alias("target"))


def rate(tilt: Column, scale: Column, size: Column, cap: float) -> Column:
    """Copies of a document, on average: its tilt, or the cap. A null tilt is beyond every number."""
    return F.when(size == 0, F.lit(1.0)).otherwise(F.coalesce(F.least(F.exp(F.least(tilt * size / scale, F.lit(50.0))), F.lit(float(cap))), F.lit(float(cap))))


def tilts(counts: DataFrame, goals: DataFrame, cap: float) -> DataFrame:
    """(source, source_size, target, scale, tilt) from the documents of each (source, size) and the targets: the root of the dual's gradient.

    A source whose target is the cap of all its documents has the tilt null: all of them are taken `cap` times.
    """
    words, square = (F.col("size") * F.col("n")).cast("decimal(38,0)"), F.col("size").cast("double") * F.col("size") * F.col("n")
    scales = counts.groupBy("source").agg((F.sum(square.cast("decimal(38,0)")).cast("double") / F.greatest(F.sum(words).cast("double"), F.lit(1.0))).alias("scale"))
    full = F.col("target") >= float(cap) * F.col("source_size") * (1 - 1e-12)
    start = F.when(F.col("source_size") == 0, F.lit(0.0)).when(~full, F.least(F.greatest(F.log(F.col("target") / F.col("source_size")), F.lit(-20.0)), F.lit(20.0)))
    # "_source" is never null, so that the joins are plain ones
    key = lambda df: df.withColumn("_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    now = key(goals).join(key(scales).drop("source"), "_source").select("_source", "source", "source_size", "target", F.greatest("scale", F.lit(1.0)).alias("scale"), start.alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(float("inf")).alias("off"))
    now, table = staged(now, "tilts"), staged(key(counts).where("size > 0").drop("source"), "counts")
    while now.where("tilt IS NOT NULL AND source_size > 0").limit(1).count():
        r = rate(F.col("tilt"), F.col("scale"), F.col("size"), cap)
        taken = F.col("n") * F.col("size") * r
        # decimals add up alike in any order
        moved = F.sum(taken.cast("decimal(38,6)")).cast("double").alias("_sum"), F.sum(F.when(r < float(cap), taken * F.col("size") / F.col("scale")).otherwise(0.0).cast("decimal(38,6)")).cast("double").alias("_slope")
        sums = table.join(now.select("_source", "tilt", "scale").where("tilt IS NOT NULL"), "_source").groupBy("_source").agg(*moved)
        gap, t = F.col("_sum") - F.col("target"), F.col("tilt")
        low, high = F.when(gap < 0, t).otherwise(F.col("low")), F.when(gap > 0, t).otherwise(F.col("high"))
        reach = 1 + F.abs(t)  # a step at most doubles the tilt
        step = F.when(F.col("_slope") > 0, t - F.greatest(-reach, F.least(reach, gap / F.col("_slope")))).otherwise(t - F.signum(gap) * reach)
        halved = F.when((step > low) & (step < high), step).otherwise((low + high) / 2)
        bound = F.when(low.isNotNull() & high.isNotNull(), halved).when(low.isNotNull(), F.greatest(step, low + 1e-3 * reach)).when(high.isNotNull(), F.least(step, high - 1e-3 * reach)).otherwise(step)
        off = F.abs(gap) / F.greatest(F.col("target"), F.lit(1.0))
        # settled, or the bracket has closed on neighbouring numbers
        still = (off > TOLERANCE) & F.coalesce((bound != t) & (high - low > 1e-15 * reach), F.lit(True))
        joined = now.join(sums, "_source", "left").withColumn("_still", F.coalesce(still, F.lit(False)))
        new = joined.select("_source", "source", "source_size", "target", "scale", F.when(F.col("_still"), bound).otherwise(t).alias("tilt"), low.alias("low"), high.alias("high"), F.coalesce(off, F.lit(0.0)).alias("off"), "_still")
        new = staged(new, "tilts")
        dropped(now)
        now = new.drop("_still")
        if not new.where("_still").limit(1).count():
            break
    return now.select("source", "source_size", "target", "scale", "tilt")


def rates(sized: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(source, source_size, target, scale, tilt) of every source; rate() gives a document's rate from them."""
    counts = staged(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    goals = targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")), weights, cap)
    return tilts(counts, staged(goals, "targets"), cap)


def _corrections(pdf: pd.DataFrame, most: int) -> pd.DataFrame:
    """Chooses, from large to small, the spare documents that bring a source's words closest to its target."""
    gap, out = float(pdf["gap"].iloc[0]), []
    for r in pdf.sort_values(["size", "by", "key"], ascending=[False, True, True]).itertuples():
        if r.by * gap > 0 and abs(gap - r.by * r.size) < abs(gap) and 0 <= r.copies + r.by <= most:
            out.append((r.key, r.by))
            gap -= r.by * r.size
    return pd.DataFrame(out, columns=["key", "by"])


def with_copies(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, seed: int = 23) -> DataFrame:
    """Adds source_size, target, rate and copies to rows of (key, doc_id, source, size); `key` tells rows apart."""
    goals = staged(rates(rows, weights, cap), "rates")
    r = rows.join(goals, rows.source.eqNullSafe(goals.source)).drop(goals.source)
    # the size to a sixteenth of an octave, then a salt that splits sizes which many rows share
    cell = (F.floor(F.log2(F.col("size") + 1.0) * 16) * 64 + F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(64))).cast("long")
    r = r.withColumn("rate", rate(F.col("tilt"), F.col("scale"), F.col("size"), cap)).withColumn("_part", F.floor((F.col("rate") - F.floor("rate")) * UNIT).cast("long"))
    ranked = exact_rank(r, ["source"], cell, [F.xxhash64("key", F.lit(seed)), F.col("key")], "_before", "_part")
    extra = F.expr(f"(_before + _part + {UNIT // 2}) div {UNIT} - (_before + {UNIT // 2}) div {UNIT}")
    first = staged(ranked.select("key", "doc_id", "source", "size", "source_size", "target", "rate", F.least(F.floor("rate") + extra, F.lit(cap)).cast("int").alias("copies")), "copies")
    gaps = first.groupBy("source").agg((F.max("target") - F.sum(F.col("size") * F.col("copies"))).alias("gap"))
    spare = first.where("size > 0").withColumn("by", F.explode(F.array(F.lit(1), F.lit(-1)))).where(F.expr(f"copies + by between 0 and {cap}"))
    slot = [F.col("source"), F.floor(F.log2("size")).alias("octave"), F.col("by"), F.pmod(F.xxhash64("key"), F.lit(SPARE)).alias("slot")]
    spare = spare.groupBy(*slot).agg(F.min(F.struct("size", "key", "copies")).alias("s")).select("source", "by", "s.*")
    chosen = spare.join(gaps, spare.source.eqNullSafe(gaps.source)).drop(gaps.source).groupBy("source").applyInPandas(lambda pdf: _corrections(pdf, cap), "key string, by int")
    chosen = chosen.groupBy("key").agg(F.sum("by").cast("int").alias("by"))
    return first.join(chosen, "key", "left").withColumn("copies", F.greatest(F.lit(0), F.least(F.lit(cap), F.col("copies") + F.coalesce("by", F.lit(0))))).drop("by")


def keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, source, size). Rows alike in doc_id, source and text share the part of the key before its last colon and are counted behind it."""
    rows = docs.select(_same(docs).alias("_same"), F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"))
    n = F.row_number().over(Window.partitionBy("_same").orderBy("size"))
    return rows.select(F.concat("_same", F.lit(":"), n.cast("string")).alias("key"), "doc_id", "source", "size")


def _same(docs: DataFrame) -> Column:
    return F.concat_ws(":", F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.coalesce(F.hex(docs["source"]), F.lit("-")), F.hex(F.xxhash64(docs["text"])))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, rate and copies for every row of docs."""
    return with_copies(staged(keyed(docs), "sizes"), weights, cap).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "source", "rate", "copies")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """The rows of docs, each as often as the mix takes it (a row without words once). Rows travel as one value, so no name of theirs can clash."""
    sizes = staged(keyed(docs), "sizes")
    copies = with_copies(sizes, weights, cap).groupBy(F.expr("substring(key, 1, length(key) - length(substring_index(key, ':', -1)) - 1)").alias("same")).agg(F.array_sort(F.collect_list("copies")).alias("each"))
    rows = docs.select(_same(docs).alias("same"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    taken = rows.join(copies.where("exists(each, c -> c > 0)").hint("merge"), "same")
    rest = F.to_json(F.struct(*[F.col("row")[c] for c in docs.columns if c != "text"]))
    nth = taken.withColumn("nth", F.row_number().over(Window.partitionBy("same").orderBy(rest)))
    times = F.when(F.size("each") == 1, F.element_at("each", 1)).otherwise(F.element_at("each", F.col("nth")))
    return nth.select("row", F.explode(F.array_repeat(F.lit(1), times)).alias("time")).select("row.*")
