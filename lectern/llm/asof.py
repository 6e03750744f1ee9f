"""Tolerant as-of join: each event meets the latest order of its client at or before it, at most `tolerance` earlier.

Time is cut into buckets as wide as the tolerance, so an event's order lies in its own bucket or in the one before. Orders stand in their
own bucket; of every bucket the latest order stands in the next bucket besides (an earlier one of that bucket can never win there). Events
and orders are equi-joined on (client, bucket), filtered exactly, and row_number by the tie order picks one.

A (client, bucket) with more than `dense` events and orders is not joined: it is cut into `radix` equal parts, and these again, until a part
has few rows or no order, or is one microsecond wide. Of the parts before an event's own part only their latest order counts; it comes
from a running last over the occupied parts of one bucket (at most `radix`), so no key is gathered, and pairs per event stay below `dense`.
Counts and latest orders are combined before the shuffle. Where that many events share one client and one microsecond, the join
with the part's single row is left to Spark's skew join.

Ties: the smaller priority, then the larger sale_id; a null loses to any value. Orders at one time of one client are reduced to the best and their count
first. Nulls and edge cases: an event or order without client or time never matches; a null event id is one event, like any other id; of copies of
an event with differing values the least (client, time) counts, nulls first; repeated order rows are orders each; an empty table on either side gives
no match or no row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import staged

HOUR = 3_600_000_000
TOLERANCE = 240 * HOUR
#: Rows of a bucket above which it is cut, and into how many parts.
DENSE, RADIX = 256, 256


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a timestamp; one without a zone is read as UTC."""
    t = df[name]
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        seconds = F.unix_date(t.cast("date")).cast("long") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60
        return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")
    return F.unix_micros(t)


def _crc(col: Column) -> Column:
    return F.crc32(col.cast("string").cast("binary"))


def _used(number: Column, t: Column, grain: int) -> Column:
    """The time, floored to the grain where the number's crc32 is odd."""
    return F.when(_crc(number) % 2 == 1, t - F.pmod(t, F.lit(grain))).otherwise(t)


def events_of(clicks: DataFrame, grain: int = HOUR) -> DataFrame:
    """(click_id, client_id, ts_us): one row for each click_id."""
    rows = clicks.select("click_id", "client_id", micros(clicks, "ts").alias("us"))
    one = rows.groupBy("click_id").agg(F.min(F.struct("client_id", "us")).alias("x")).select("click_id", "x.*")
    return one.select("click_id", "client_id", _used(F.col("click_id"), F.col("us"), grain).alias("ts_us"))


def orders_of(sales: DataFrame, grain: int = HOUR) -> DataFrame:
    """(client_id, t, sale_id, priority, cents): each row, and a second order where the id's crc32 is not divisible by 3."""
    cents = F.when(F.abs(F.col("total")) < 9e16, F.floor(100 * F.col("total") + 0.5))
    rows = sales.select("client_id", _used(F.col("sale_id"), micros(sales, "sold_at"), grain).alias("t"), "sale_id", F.col("priority").cast("long").alias("priority"), cents.alias("cents"))
    one = F.struct("sale_id", "priority")
    two = F.struct((-1 - F.col("sale_id")).alias("sale_id"), (6 - F.col("priority")).alias("priority"))
    both = F.when(_crc(F.col("sale_id")) % 3 != 0, F.array(one, two)).otherwise(F.array(one))
    return rows.select("client_id", "t", "cents", F.explode(both).alias("o")).select("client_id", "t", "o.sale_id", "o.priority", "cents")


def moments(orders: DataFrame) -> DataFrame:
    """(client_id, t, order): the best order (t, sale_id, cents, tied) of each client and time."""
    tie = F.struct(F.isnull("priority").alias("a"), F.col("priority").alias("b"), F.isnull("sale_id").alias("c"), F.bitwise_not("sale_id").alias("d"), "cents")
    best = orders.where("client_id IS NOT NULL AND t IS NOT NULL").groupBy("client_id", "t").agg(F.min(tie).alias("x"), F.count(F.lit(1)).alias("tied"))
    order = F.struct("t", F.bitwise_not(F.col("x.d")).alias("sale_id"), F.col("x.cents").alias("cents"), "tied")
    return best.select("client_id", "t", order.alias("order"))


def _parts(events: DataFrame, points: DataFrame, at: str, part: str) -> DataFrame:
    """(client_id, at, part, n, last, rows, before): occupied parts of each bucket, their orders, the bucket's rows, the latest order before the part."""
    none = F.lit(None).cast(points.schema["order"].dataType)
    both = points.select("client_id", at, part, F.lit(1).alias("n"), "order").unionByName(events.select("client_id", at, part, F.lit(0).alias("n"), none.alias("order")))
    found = both.groupBy("client_id", at, part).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m"), F.max("order").alias("last"))
    bucket = Window.partitionBy("client_id", at)
    earlier = bucket.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return found.select("client_id", at, part, "n", "last", F.sum("m").over(bucket).alias("rows"), F.last("last", True).over(earlier).alias("before"))


def _few(events: DataFrame, points: DataFrame, at: str) -> DataFrame:
    """Events with the best order of their bucket at or before them, or else the one carried to them."""
    right = points.select(F.col("client_id").alias("_c"), F.col(at).alias("_at"), F.col("order").alias("_o"))
    on = (F.col("client_id") == F.col("_c")) & (F.col(at) == F.col("_at")) & (F.col("_o.t") <= F.col("ts_us"))
    pairs = events.join(right, on, "left")
    by = Window.partitionBy("client_id", at, "click_id").orderBy(F.col("_o.t").desc_nulls_last())
    best = pairs.withColumn("_i", F.row_number().over(by)).where("_i = 1")
    return best.select("click_id", "client_id", "ts_us", F.coalesce("_o", "carry").alias("order"))


def latest(events: DataFrame, points: DataFrame, tolerance: int = TOLERANCE, dense: int = DENSE, radix: int = RADIX) -> DataFrame:
    """(click_id, client_id, ts_us, order) for events with client and time: the latest order at or before them in their bucket or the one before."""
    none = F.lit(None).cast(points.schema["order"].dataType)
    start = lambda t: t - F.pmod(t, F.lit(tolerance))
    events = events.withColumn("at", start(F.col("ts_us"))).withColumn("carry", none)
    points = points.withColumn("at", start(F.col("t")))
    width, out, first = tolerance, None, True
    while True:
        step = -(-width // radix)
        inside = lambda t, step=step: F.expr(f"at + (({t} - at) div {step}) * {step}")
        events, points = events.withColumn("part", inside("ts_us")), points.withColumn("part", inside("t"))
        parts = staged(_parts(events, points, "at", "part"), "asof-parts")
        heavy = parts.where(F.col("rows") > dense) if width > 1 else parts.where("false")
        if first:
            carried = parts.groupBy("client_id", "at").agg(F.max("last").alias("order")).where("order IS NOT NULL").select("client_id", (F.col("at") + tolerance).alias("at"), "order")
            heavy = heavy.join(carried.withColumnRenamed("order", "prior"), ["client_id", "at"], "left").withColumn("before", F.coalesce("before", "prior"))
        known = heavy.select("client_id", "part", "n", "before")
        # every row learns whether its bucket is cut (n, the part's orders) or not (null)
        events = staged(events.join(known, ["client_id", "part"], "left"), "asof-events")
        points = staged(points.join(known.select("client_id", "part", "n"), ["client_id", "part"], "left"), "asof-points")
        rest = points.where("n IS NULL").select("client_id", "at", "order")
        done = _few(events.where("n IS NULL"), rest.unionByName(carried) if first else rest, "at")
        ended = events.where("n = 0").select("click_id", "client_id", "ts_us", F.coalesce("before", "carry").alias("order"))
        out = done.unionByName(ended) if out is None else out.unionByName(done).unionByName(ended)
        if not heavy.limit(1).count():
            return out
        events = events.where("n > 0").select("click_id", "client_id", "ts_us", F.coalesce("before", "carry").alias("carry"), F.col("part").alias("at"))
        points = points.where("n > 0").select("client_id", "t", "order", F.col("part").alias("at"))
        width, first = step, False


def matched(clicks: DataFrame, sales: DataFrame, tolerance: int = TOLERANCE, grain: int = HOUR, dense: int = DENSE, radix: int = RADIX) -> DataFrame:
    """(click_id, client_id, ts_us, sale_id, lag_us, total_cents, n_tied) for every click_id."""
    events = staged(events_of(clicks, grain), "asof-clicks")
    points = staged(moments(orders_of(sales, grain)), "asof-orders")
    keyed = "client_id IS NOT NULL AND ts_us IS NOT NULL"
    found = latest(events.where(keyed), points, tolerance, dense, radix)
    alone = events.where(f"NOT ({keyed})").withColumn("order", F.lit(None).cast(points.schema["order"].dataType))
    hit = F.col("ts_us") - F.col("order.t") <= tolerance
    value = lambda c: F.when(hit, c).cast("long")
    return found.unionByName(alone).select(
        F.col("click_id").cast("long").alias("click_id"), F.col("client_id").cast("long").alias("client_id"), "ts_us", value(F.col("order.sale_id")).alias("sale_id"),
        value(F.col("ts_us") - F.col("order.t")).alias("lag_us"), value(F.col("order.cents")).alias("total_cents"), F.coalesce(value(F.col("order.tied")), F.lit(0)).cast("long").alias("n_tied"),
    )


def _crc_sql(digits: str) -> str:
    """crc32 of a decimal in DuckDB: each byte is one element, seven zeros follow it, and every element shifts once."""
    octets = f"flatten(list_transform(string_split(CAST({digits} AS VARCHAR), ''), lambda ch: [CAST(ascii(ch) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    step = "xor(xor(acc, x) >> 1, 3988292384 * (xor(acc, x) & 1))"
    return f"(CASE WHEN {digits} IS NOT NULL THEN xor(list_reduce({octets}, lambda acc, x: {step}, CAST(4294967295 AS BIGINT)), 4294967295) END)"


SQL = f"""
WITH c AS (SELECT click_id, min(client_id) AS client_id, epoch_us(min(ts)) AS us, {_crc_sql("click_id")} AS h FROM clicks GROUP BY click_id),
e AS (SELECT click_id, client_id, CASE WHEN h % 2 = 1 THEN us - us % {HOUR} ELSE us END AS ts_us FROM c),
s AS (SELECT *, epoch_us(sold_at) AS us, {_crc_sql("sale_id")} AS h FROM sales),
o1 AS (SELECT client_id, sale_id, priority, total, CASE WHEN h % 2 = 1 THEN us - us % {HOUR} ELSE us END AS t, h FROM s),
o AS (SELECT client_id, sale_id, priority, total, t FROM o1 UNION ALL SELECT client_id, -1 - sale_id, 6 - priority, total, t FROM o1 WHERE h % 3 <> 0),
p AS (SELECT client_id, t, sale_id, total, count(*) OVER (PARTITION BY client_id, t) AS n_tied,
        row_number() OVER (PARTITION BY client_id, t ORDER BY priority NULLS LAST, sale_id DESC NULLS LAST) AS i
      FROM o WHERE client_id IS NOT NULL AND t IS NOT NULL),
m AS (SELECT e.click_id, e.client_id, e.ts_us, p.t, p.sale_id, p.total, p.n_tied
      FROM e ASOF LEFT JOIN (SELECT * FROM p WHERE i = 1) p ON e.client_id = p.client_id AND e.ts_us >= p.t)
SELECT click_id, client_id, ts_us, CASE WHEN ts_us - t <= {TOLERANCE} THEN sale_id END AS sale_id,
  CASE WHEN ts_us - t <= {TOLERANCE} THEN ts_us - t END AS lag_us,
  CASE WHEN ts_us - t <= {TOLERANCE} THEN CAST(floor(100 * total + 0.5) AS BIGINT) END AS total_cents,
  CASE WHEN ts_us - t <= {TOLERANCE} THEN n_tied ELSE 0 END AS n_tied
FROM m
"""
