"""Joins by position: points inside spans of any length, and the latest row before a position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Stretches of positions that `last_before` orders on their own.
CELLS = 1024


def _level(length: Column) -> Column:
    """The least power of two (its exponent) that is no shorter than the length."""
    return F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1))).cast("int")


def inside(spans: DataFrame, points: DataFrame, key: str, start: str, end: str, at: str) -> DataFrame:
    """Every span with every point of its key that lies in it, both ends included.

    Positions are cut into cells as wide as a power of two, one width for each class of span lengths. A span lies in two cells of its own class at most, a point in
    one cell of each class that occurs (64 at most), so both meet once in an equi-join on (key, class, cell), whatever the spans' lengths. Spans and points without
    key or position, and spans that end before they start, meet nothing.
    """
    s = spans.where(F.col(key).isNotNull() & (F.col(end) >= F.col(start))).withColumn("_class", _level(F.col(end) - F.col(start) + 1))
    classes = [r[0] for r in s.select("_class").distinct().collect()]  # at most 64 numbers
    if not classes:
        return spans.join(points.withColumnRenamed(key, "_key"), F.lit(False)).drop("_key")
    low, high = (F.expr(f"shiftright(cast({x} as bigint), _class)") for x in (start, end))
    s = s.withColumn("_cell", F.explode(F.sequence(low, high)))
    p = points.where(F.col(key).isNotNull() & F.col(at).isNotNull()).withColumn("_class", F.explode(F.array(*[F.lit(c) for c in sorted(classes)])))
    p = p.withColumn("_cell", F.expr(f"shiftright(cast({at} as bigint), _class)"))
    return s.join(p, [key, "_class", "_cell"]).where(F.col(at).between(F.col(start), F.col(end))).drop("_class", "_cell")


def without(spans: DataFrame, points: DataFrame, key: str, start: str, end: str, at: str, id: str) -> DataFrame:
    """The spans with no point in them; `id` tells spans apart."""
    met = inside(spans.select(id, key, start, end), points.select(key, at), key, start, end, at).select(id).distinct()
    return spans.join(met, id, "left_anti")


def last_before(rows: DataFrame, others: DataFrame, key: str, at: str, value: str, cells: int = CELLS) -> DataFrame:
    """rows with the struct `value` (at, ...) of the latest row of `others` (key, at, ...) of the same key at or before `at`; null where there is none.

    Positions are cut into `cells` equal stretches. Inside (key, stretch) both sides are ordered together; what an earlier stretch leaves is carried over by a
    window over the stretches' last rows, `cells` at most for each key. Ties: the greatest row of `others` at a position, by all its columns.
    """
    span = rows.select(at).unionByName(others.select(at)).agg(F.min(at).alias("_low"), F.max(at).alias("_high"))
    wide = F.greatest(F.lit(1), F.ceil((F.col("_high") - F.col("_low") + 1) / cells))
    cut = lambda df: df.crossJoin(F.broadcast(span)).withColumn("_cell", F.floor((F.col(at) - F.col("_low")) / wide)).drop("_low", "_high")
    told = F.struct(F.col(at), *[F.col(c) for c in others.columns if c not in (key, at)])
    right = cut(others.where(F.col(key).isNotNull() & F.col(at).isNotNull())).groupBy(key, "_cell", at).agg(F.max(told).alias(value))
    left = cut(rows)
    both = left.withColumn(value, F.lit(None).cast(right.schema[value].dataType)).withColumn("_left", F.lit(1))
    both = both.unionByName(right.withColumn("_left", F.lit(0)), allowMissingColumns=True)
    ordered = Window.partitionBy(key, "_cell").orderBy(at, "_left").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn(value, F.last(value, True).over(ordered)).where("_left = 1").drop("_left")
    # the last row of each stretch, and before it: stretches with rows of either side
    marks = both.groupBy(key, "_cell").agg(F.max(value).alias("_end"))
    earlier = Window.partitionBy(key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn("_carry", F.last("_end", True).over(earlier)).select(key, "_cell", "_carry")
    same = (near[key].eqNullSafe(carried[key])) & (near["_cell"].eqNullSafe(carried["_cell"]))
    out = near.join(carried.where(F.col(key).isNotNull()), same, "left").select(*[near[c] for c in rows.columns], F.coalesce(near[value], carried["_carry"]).alias(value))
    return out
