"""Small cases of the findings of round 3."""

import datetime
import os

import duckdb

from lectern.operators import postings, retrieve
from lectern.registry import ORACLES, QUERIES
from lectern.sources import readers, sinks
from lectern.streaming import folds


def against_sql(spark, name, folder, **tables):
    """Rows of a query and of its SQL over small tables (rows, DDL) that lie in folder."""
    con = duckdb.connect()
    for t, (rows, ddl) in tables.items():
        path = os.path.join(str(folder), f"{t}.parquet")
        spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(f"{folder}/_{t}")
        con.execute(f"COPY (SELECT * FROM '{folder}/_{t}/*.parquet') TO '{path}' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, str(folder))
    want = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in df.columns)} FROM ({ORACLES[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=repr), sorted(want, key=repr)


def test_invariants_of_records_with_one_number(spark, tmp_path):
    lines = [(1, 1, 100065), (1, 2, 65), (2, 1, 7)]  # the first two have the number 1200065; only the first is ambiguous, only the second valid
    orders = [(1,), (2,)]
    got, want = against_sql(spark, "z19_invariants", tmp_path, lineitem=(lines, "l_orderkey long, l_linenumber int, l_partkey long"), orders=(orders, "o_orderkey long"))
    assert got == want and ("unconfirmed_meaning", 1200065) not in got and ("unconfirmed_meaning", 2100007) in got


def test_commits_keep_state_by_hour(spark, tmp_path):
    start = datetime.datetime(2024, 2, 28, 22, 59, 59, 999999)
    minutes = (0, 1, 59, 60, 61, 119, 120, 121)
    kind = "event_id long, user_id long, event_type string, ts timestamp_ntz"
    rows = [(i * 2 + j, 3 + 10 * j, ("view", "click")[j], start + datetime.timedelta(minutes=m)) for i, m in enumerate(minutes) for j in (0, 1)]
    got, want = against_sql(spark, "x02_commits", tmp_path, events=(rows, kind))
    assert got == want and len(got) > len(minutes)
    stream = lambda at: spark.readStream.schema("id long, ts timestamp").parquet(str(tmp_path)).withColumnRenamed("ts", at)
    met = folds.commits(stream("ts").withColumnRenamed("id", "action_id"), stream("delivered_ts").withColumnRenamed("id", "delivered_id"))
    assert "_hour" in met._jdf.queryExecution().analyzed().toString() and met.columns == ["action_id", "ts", "delivered_id", "delivered_ts"]


def test_folders_of_traces_do_not_grow_with_sessions(spark, tmp_path):
    at = datetime.datetime(2024, 2, 28, 12)
    rows = [(s, s * 10 + d, at + datetime.timedelta(days=d)) for s in range(100) for d in (0, 1)]
    root = str(tmp_path / "traces")
    for part in (rows[:120], rows[120:]):
        sinks.append_events(spark.createDataFrame(part, "session_id long, event_id long, created_at timestamp"), root)
    folders = [d for d, _, files in os.walk(root) if any(f.endswith(".json") for f in files)]
    assert len(folders) <= 2 * readers.SHELVES
    schema = "event_id long, created_at timestamp, day string, session_id long"
    read = readers.traces(spark, root, schema)
    assert "shelf" not in read.columns and sorted((r.session_id, r.event_id, r.created_at) for r in read.collect()) == sorted(rows)
    assert sorted((r.event_id, str(r.day)) for r in readers.traces(spark, root, schema, 7).collect()) == [(70, "2024-02-28"), (71, "2024-02-29")]


def test_containment_inside_words_and_of_short_items(spark, tmp_path):
    docs = [(1, "see the limit of a  sum\nexists here"), (2, "sixthe limit of a sum existsagain"), (3, "the limit"), (4, None), (5, ""), (6, "bathe limits")]
    asked = [(1, "the limit of a sum exists"), (2, "the limit"), (3, "missing words are never found in here"), (4, "lim")]
    got, want = against_sql(spark, "j09_containment", tmp_path, documents=(docs, "doc_id long, text string"), benchmark=(asked, "item_id long, text string"))
    assert got == want and got[:2] == [(1, 2, 1), (2, 4, 1)]


def test_search_writes_a_phrase_once_however_many_ask_for_it(spark, monkeypatch):
    passages = spark.createDataFrame([(i, "the rate of the integral " * (i % 4)) for i in range(40)] + [(99, None)], "passage_id long, body string")
    asked = spark.createDataFrame([(q, ('rate integral', '"rate of the" OR missing')[q % 2]) for q in range(30)], "query_id long, query string")
    seen = {}
    plain = postings.staged
    monkeypatch.setattr(postings, "staged", lambda df, tag: seen.setdefault(tag, plain(df, tag)))
    got = sorted((r.query_id, r["rank"], r.passage_id, r.n_phrases) for r in postings.search(asked, passages, 3).collect())
    assert {q: [x[2:] for x in got if x[0] == q] for q in range(0, 30, 2)} == {q: [x[2:] for x in got if x[0] == 0] for q in range(0, 30, 2)}
    assert all(p % 4 for _, _, p, _ in got) and len(got) == 90
    assert seen["hits"].count() == 30 * 3  # 30 passages with text, three phrases that occur


def test_full_text_counts_only_words_asked_for(spark, monkeypatch):
    passages = spark.createDataFrame([(i, f"integral integrals limit word{i} rate") for i in range(30)] + [(99, None), (98, "")], "passage_id long, body string")
    asked = spark.createDataFrame([(q, "integrals missing") for q in range(20)], "query_id long, query string")
    seen = {}
    plain = retrieve.staged
    monkeypatch.setattr(retrieve, "staged", lambda df, tag: seen.setdefault(tag, plain(df, tag)))
    got = [(r.query_id, r["rank"], r.passage_id) for r in retrieve.full_text(asked, passages, 2).collect()]
    assert sorted(got) == [(q, n, n - 1) for q in range(20) for n in (1, 2)]
    assert seen["tf"].count() == 30
