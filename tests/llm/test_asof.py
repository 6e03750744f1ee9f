"""The tolerant as-of join against a plain search: ties, odd rows, buckets cut down to a microsecond."""

import random
import zlib

import pytest

from lectern.llm import asof

CLICKS = "click_id long, client_id long, ts timestamp_ntz, part string"
SALES = "sale_id long, client_id long, total double, sold_at timestamp_ntz, priority int, AT string"
HOUR = asof.HOUR


def odd(n):
    return n is not None and zlib.crc32(str(n).encode()) % 2 == 1


def plain(clicks, sales, tolerance):
    orders = {}
    for sale, client, total, at, priority in sales:
        if at is None:
            continue
        t = at - at % HOUR if odd(sale) else at
        pair = [(sale, priority)]
        if sale is not None and zlib.crc32(str(sale).encode()) % 3:
            pair.append((-1 - sale, None if priority is None else 6 - priority))
        for s, p in pair:
            orders.setdefault(client, []).append((t, s, p, total))
    seen, out = {}, []
    for click, client, at in clicks:
        seen.setdefault(click, (client, at))
    for click, (client, at) in seen.items():
        ts = None if at is None else at - at % HOUR if odd(click) else at
        fit = [o for o in orders.get(client, []) if client is not None and ts is not None and 0 <= ts - o[0] <= tolerance]
        if not fit:
            out.append((click, client, ts, None, None, None, 0))
            continue
        t = max(o[0] for o in fit)
        tied = [o for o in fit if o[0] == t]
        best = min(tied, key=lambda o: (o[2] is None, o[2] or 0, o[1] is None, -(o[1] or 0)))
        cents = None if best[3] is None else int(100 * best[3] + 0.5)
        out.append((click, client, ts, best[1], ts - t, cents, len(tied)))
    return out


def frames(spark, clicks, sales):
    from pyspark.sql import functions as F

    def stamped(df, name):
        return df.withColumn(name, F.timestamp_micros("us").cast("timestamp_ntz")).drop("us")

    c = stamped(spark.createDataFrame(clicks, "click_id long, client_id long, us long"), "ts").withColumn("part", F.lit("x"))
    s = stamped(spark.createDataFrame(sales, "sale_id long, client_id long, total double, us long, priority int"), "sold_at").withColumn("AT", F.lit("x"))
    return c, s


def data(seed, n=300, clients=3, span=40 * 24 * HOUR):
    r = random.Random(seed)
    base = 1_704_067_200_000_000
    time = lambda: None if r.random() < 0.03 else base + r.randrange(span) // r.choice([1, 1, HOUR]) * 1
    client = lambda: None if r.random() < 0.03 else min(r.randrange(clients), r.randrange(clients))
    clicks = [(i, client(), time()) for i in range(n)]
    clicks += clicks[:20] + [(None, 0, base + span // 2)]
    sales = [(i, client(), r.choice([None, 1.005, 20.0, r.random() * 100]), time(), r.choice([None, 0, 1, 3])) for i in range(n // 2)]
    sales += sales[:30] + [(None, 0, 5.0, base + 5, 1), (None, 0, 5.0, base + 5, None)]
    return clicks, sales


@pytest.mark.parametrize("dense, radix, hours", [(256, 256, 240), (8, 64, 240), (8, 256, 7)])
def test_against_plain_search(spark, dense, radix, hours):
    clicks, sales = data(dense)
    out = asof.matched(*frames(spark, clicks, sales), tolerance=hours * HOUR, dense=dense, radix=radix)
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, plain(clicks, sales, hours * HOUR)))


def test_one_client_and_neighbouring_microseconds(spark):
    base = 1_704_067_200_000_000 - 3
    sales = [(i, 1, 1.0, base + i % 12, i % 3) for i in range(0, 60)]
    clicks = [(i, 1, base + i % 15) for i in range(80)] + [(1000 + i, 1, base + 240 * HOUR + i) for i in range(0, 16)]
    out = asof.matched(*frames(spark, clicks, sales), dense=3, radix=64)
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, plain(clicks, sales, 240 * HOUR)))


def test_empty_sides(spark):
    clicks, sales = data(5, n=10)
    c, s = frames(spark, clicks, sales)
    assert asof.matched(c.limit(0), s).count() == 0
    assert {r.n_tied for r in asof.matched(c, s.limit(0)).collect()} == {0}
