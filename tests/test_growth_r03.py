"""Small cases of the findings of round 3 on growth: what was worked out again and again, or for each key, is worked out once."""

import datetime
import glob
import os
import types

import numpy as np
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.operators import lessons, nearest, records, retrieve, segment
from lectern.plans import grounding
from lectern.registry import QUERIES
from lectern.streaming import folds
from lectern.streaming import lessons as lesson_stream

from .test_findings_r03 import against_sql
from .test_lessons import turns_of


def plan(df, which="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


def cuts_of(monkeypatch):
    """Counts how often a query asks for the terms of a text."""
    seen, plain = [], text.lexical_terms
    monkeypatch.setattr(text, "lexical_terms", lambda x: seen.append(str(x)) or plain(x))
    return lambda: sum("body" in x for x in seen)


def test_f11_names_and_runs_are_worked_out_once(spark, monkeypatch):
    names = [("c1", "rate of change", 0), ("c2", "chain-rule", 1), ("c3", "++", 2), ("c4", "f(x)", 3), ("c5", "x", 4), ("c6", "a  b", 5), ("c7", None, 6), ("c8", "c+", 7)]
    texts = [(1, "Rate  of-change, x"), (2, "the chain-rule of f(x)"), (3, "chain rule a\nb"), (4, None), (5, ""), (6, "  rate of changes c++ x "), (7, "\U0001d465 a b \U0001d465")]
    rows = spark.createDataFrame([(i, None, t) for i, t in texts], "doc_id long, heading string, text string")
    asked, plain = [], segment.staged
    monkeypatch.setattr(segment, "staged", lambda df, tag: asked.append(tag) or plain(df, tag))
    got = {r.doc_id: r.concept_ids for r in segment.tagged_by(rows, spark.createDataFrame(names, "concept_id string, name string, ordinal int"), ["doc_id"]).collect()}
    assert got == {1: ["c1", "c5"], 2: ["c2", "c4", "c5"], 3: ["c6"], 4: [], 5: [], 6: ["c5", "c8"], 7: ["c6"]} and asked == ["names"]
    tab = segment.tagged_by(rows, spark.createDataFrame([("t", "\tb", 0), ("u", "rate", 1)], "concept_id string, name string, ordinal int"), ["doc_id"])
    assert {r.doc_id: r.concept_ids for r in tab.collect()} == {1: ["u"], 2: [], 3: ["t"], 4: [], 5: [], 6: ["u"], 7: ["t"]}


def test_f12_sessions_are_folded_in_batches_of_rows(spark):
    turns = turns_of(spark)
    got = lessons.chosen(turns)
    assert "FlatMapGroupsInPandas" not in plan(got, "executedPlan")
    want = []
    for _, df in turns.toPandas().groupby("session_id"):
        lesson = lessons.Lesson()
        for t in lessons._plain([df]):
            card, variant = lesson.choose(t)
            lesson.present(card, t.shown)
            want.append(lesson.row(t, card, variant, "shown" if t.shown else "fallback"))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_f13_files_do_not_grow_with_conversations(spark, tmp_path):
    rows = [(c, t, f"turn {t}\r\nof {c}") for c in range(60) for t in range(3)] + [(7, 9, None), (99, 1, ""), (100, 1, "\n")]
    before = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')[7:]}/texts-*"))
    got, want = against_sql(spark, "s03_text_files", tmp_path, conversations=(rows, "conv_id long, turn int, text string"))
    new = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')[7:]}/texts-*")) - before
    files = [f for top in new for _, _, fs in os.walk(top) for f in fs if f.endswith(".txt")]
    assert got == want and len(got) == 62 and len(files) <= 8


def test_f15_fields_are_put_together_once(spark):
    rows = spark.range(40).select(F.col("id"), F.map_from_arrays(F.array(F.lit("id"), F.lit("title"), F.lit("odd")), F.array(F.lit(""), F.col("id").cast("string"), F.lit("x"))).alias("fields"))
    fields = F.map_from_arrays(F.map_keys("fields"), F.map_values("fields"))
    got = rows.select(records.field_errors(F.lit("Course"), fields, F.col("id") > 3).alias("e"))
    assert plan(got).count("map_from_arrays(map_keys") == 1 and "V-02 unknown odd" in got.first().e


def test_f16_words_are_cut_once(spark):
    rows = spark.createDataFrame([("so a b  C d e f g", "x a b c d e f"), ("a b c", "a b c"), (None, "a b c d e f"), ("a b c d e f", None)], "q string, m string")
    got = rows.select(text.copies_text(F.col("q"), F.col("m")).alias("c"))
    assert plan(got).count("split(") == 1 and [r.c for r in got.collect()] == [True, False, None, False]


def test_f17_two_passes_cut_texts_once(spark, tmp_path, monkeypatch):
    docs = [(i, ["limit of sums", "limit rate", "the integral of a limit sum", ""][i % 4], ("en", "de", None)[i % 3], "s", 1) for i in range(30)] + [(77, None, "en", "s", 1)]
    asked = [(1, "limit of a sum"), (2, "integral rate"), (3, "nothing")]
    cuts = cuts_of(monkeypatch)
    got, want = against_sql(spark, "r14_two_pass", tmp_path, documents=(docs, "doc_id long, text string, lang string, source string, n_chars long"), benchmark=(asked, "item_id long, text string"))
    assert got == want and len(got) == 8 and cuts() == 1


def test_f18_state_is_read_and_written_once_for_rows(spark):
    calls = []

    class Value:
        held = None
        exists = lambda self: calls.append("exists") or self.held is not None
        get = lambda self: calls.append("get") or self.held
        clear = lambda self: calls.append("clear") or setattr(self, "held", None)
        update = lambda self, x: calls.append("update") or setattr(self, "held", x)

    handle = types.SimpleNamespace(getValueState=lambda *_: Value(), registerTimer=lambda at: calls.append("timer"), deleteTimer=lambda at: calls.append("timer"))
    fold = lesson_stream.Lessons()
    fold.init(handle)
    turns = turns_of(spark, 1, 30).toPandas()
    out = [fold.handleInputRows((0,), iter([part]), None) for part in (turns[:15], turns[15:])]
    assert sum(len(df) for part in out for df in part) == 30 and len(calls) <= 2 * 2 + 5


def test_f17_f19_f21_a_passage_is_cut_into_terms_once(spark, monkeypatch):
    q, p = spark.createDataFrame([(1, "limit sum")], "query_id long, query string"), spark.createDataFrame([(1, "sum of limits")], "passage_id long, body string")
    cuts = [x for x in plan(retrieve.lexical(q, p)).split("\n") if "lower(body" in x]
    assert sum(x.count("regexp_extract_all(lower(body") for x in cuts) == 1


def test_f19_found_is_searched_once(spark, monkeypatch):
    from lectern.plans import evaluation

    tags, plain = [], evaluation.staged
    monkeypatch.setattr(evaluation, "staged", lambda df, tag: tags.append(tag) or plain(df, tag))
    df = QUERIES["a14_complete_at_k"](spark, "/root/testdata/sf0.001")
    assert tags == ["found"] and "documents" not in plan(df, "executedPlan")


def test_f20_queries_of_a_cell_are_dealt_in_shares(spark, monkeypatch):
    r = np.random.default_rng(3)
    x = r.normal(size=(90, 6))
    e = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(90)] + [(90, None)], "id long, v array<double>")
    monkeypatch.setattr(nearest, "MEET", 7)
    q, rec = e.where("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q_vec")), e.select(F.col("id").alias("record_id"), F.col("v").alias("r_vec"))
    row = lambda df: sorted((z.query_id, z["rank"], z.record_id) for z in df.collect())
    got = nearest.nearest(q, rec, 4)
    assert row(got) == row(retrieve.vector(q, rec, 4)) and "share" in plan(got)


def test_f21_checks_are_searched_once(spark, monkeypatch):
    cuts = cuts_of(monkeypatch)
    df = QUERIES["e17_citations"](spark, "/root/testdata/sf0.001")
    assert cuts() == 1 and "documents" not in plan(df, "executedPlan") and grounding.staged


def test_f22_folds_read_four_columns_in_the_order_of_time(spark, tmp_path):
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string, value double, props string").parquet(str(tmp_path))
    for fold in (folds.expiring, folds.running_state, folds.confirmed_once):
        assert any("Project [user_id#" in x and "props" not in x for x in plan(fold(stream), "analyzed").split("\n"))
    at = lambda micros, days=0: datetime.datetime(2024, 2, 28) + datetime.timedelta(days=days, microseconds=micros)
    rows = [(4, 5, "click", at(999, 1)), (1, 5, "view", at(1000)), (3, 6, "click", at(1000, 1)), (2, 6, "view", at(1999)), (9, 7, "view", at(5)), (8, 7, "view", at(5)), (7, 7, "error", at(0, 3))]
    got, want = against_sql(spark, "x03_expiring", tmp_path, events=(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz"))
    assert got == want == [(5, 1, "applied"), (6, 2, "expired"), (7, 8, "superseded"), (7, 9, "expired")]


def test_f23_no_token_is_sorted(spark, monkeypatch):
    seen, plain = {}, segment.staged
    monkeypatch.setattr(segment, "staged", lambda df, tag: seen.setdefault(tag, df) and plain(df, tag))
    docs = [("a", 2, "words again words order"), ("a", 1, "order lesser again"), ("a", 1, "third other"), (None, 3, "apple-tree apple-tree berry"), ("b", None, "zebra mango"), ("b", 4, "mango"), ("c", 5, None)]
    got = segment.topics(spark.createDataFrame(docs, "course string, passage_id long, body string"), "course", 3)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [("a", "order", 2, 1), ("a", "again", 2, 2), ("a", "words", 2, 3), (None, "apple-tree", 2, 1), (None, "berry", 1, 2), ("b", "mango", 2, 1), ("b", "zebra", 1, 2)]))
    assert "SortAggregate" not in plan(seen["topics"], "executedPlan")
