"""Widening scopes, places of whole tables, stores with one writer, observed members of JSON."""

import pytest
from pyspark.sql import functions as F

from lectern.operators import context, retrieve
from lectern.sources import sinks


def test_scopes_widen_for_short_queries_only(spark):
    passages = spark.createDataFrame([(1, "limit series", "near"), (2, "limit chain", "near"), (3, "limit rule", "mid"), (4, "series power", "far"), (5, "limit point", "far")], "passage_id int, body string, where string")
    queries = spark.createDataFrame([(10, "limit"), (11, "series"), (12, "zzz")], "query_id int, query string")
    asked = []

    def search(q, p, k):
        asked.append(sorted(r.query_id for r in q.collect()))
        return retrieve.lexical(q, p.drop("where"), k)

    tiers = [F.col("where") == "near", F.col("where").isin("near", "mid"), F.lit(True)]
    got = {(r.query_id, r["rank"]): (r.passage_id, r.tier) for r in retrieve.widened(queries, passages, tiers, 2, search).collect()}
    assert got == {(10, 1): (1, 0), (10, 2): (2, 0), (11, 1): (1, 0), (11, 2): (4, 2)}
    assert asked == [[10, 11, 12], [11, 12], [11, 12]]


def test_wide_scopes_are_not_read_if_nobody_is_short(spark):
    passages = spark.createDataFrame([(1, "limit"), (2, "limit")], "passage_id int, body string")
    asked = []

    def search(q, p, k):
        asked.append(1)
        return retrieve.lexical(q, p, k)

    out = retrieve.widened(spark.createDataFrame([(1, "limit")], "query_id int, query string"), passages, [F.lit(True), F.lit(True)], 2, search)
    assert out.count() == 2 and asked == [1]


def test_places_follow_the_order_of_the_whole_table(spark):
    rows = spark.createDataFrame([(i * 7919 % 1000, f"x{i % 3}") for i in range(500)], "n int, s string").repartition(5)
    placed = context.placed(rows, ["s", "n"], "place").collect()
    assert [r.place for r in sorted(placed, key=lambda r: (r.s, r.n))] == list(range(1, 501))
    assert context.placed(rows.limit(0), ["s", "n"], "place").count() == 0


def test_a_store_has_one_writer(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(1, "a")], "record_id int, x string")
    with sinks.claimed(spark, path):
        with pytest.raises(ValueError, match="being written"):
            sinks.write_once(rows, path)
    assert sinks.write_once(rows, path) == 1
    with pytest.raises(ValueError, match="stored already"):
        sinks.write_once(rows, path)
    assert sinks.write_once(rows.withColumn("record_id", F.lit(2)), path) == 1 and spark.read.parquet(path).count() == 2


def test_observed_members(spark):
    texts = ['{"a": 1, "b": null}', '{"a": "x", "b": [1]}', '{"a": 2.5, "c": {"d": true}}', "{}", "[1]", "{oops", None, '{"b": false}']
    got = {(r.field, r.kind): r.n for r in sinks.json_fields(spark.createDataFrame([(t,) for t in texts], "t string"), "t").collect()}
    assert got == {("a", "number"): 2, ("a", "string"): 1, ("b", "null"): 1, ("b", "array"): 1, ("b", "boolean"): 1, ("c", "object"): 1, (None, "broken"): 2}
