import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.functions import ports
from lectern.operators import context, ground, retrieve, segment, tutor
from lectern.registry import QUERIES
from lectern.sources import readers, sinks


def test_size_flush(spark):
    df = spark.createDataFrame([([1000, 500, 10, 2000, 5],), ([],)], "n array<int>")
    assert [r[0] for r in df.select(segment.size_flushes(F.col("n"))).collect()] == [[0, 0, 1, 1, 2], []]


def test_blocks_follow_headings(spark):
    body = "Chapter 1: Start\nintro\nDefinition: a limit\nmore\n1.2 Next\ntext\nChapter 0: none\nlast"
    docs = spark.createDataFrame([("d", 1, body)], "document_id string, page_number int, body string")
    b = segment.blocks(segment.tracked(segment.classified(segment.lines(docs)))).orderBy("block_ordinal").collect()
    assert [(r.block_type, r.chapter_id, r.section_id, r.line_start, r.line_end) for r in b] == [("explanation", "1", None, 1, 2), ("definition", "1", None, 3, 4), ("explanation", "1", "1.2", 5, 6), ("explanation", None, None, 7, 8)]
    assert [r.block_no for r in b] == [1, 2, 1, 1] and b[1].label == "Definition: a limit"


def test_propagation_treats_nulls_as_a_place(spark):
    rows = spark.createDataFrame([("d", None, None, ["c"]), ("d", None, None, []), ("d", "1", None, [])], "document_id string, chapter_id string, section_id string, concept_ids array<string>")
    assert sorted(map(str, (r.concept_ids for r in segment.propagated(rows).collect()))) == ["['c']", "['c']", "[]"]


def test_budget_skips_and_goes_on(spark):
    rows = spark.createDataFrame([(1, 1, 10, 7000), (1, 2, 11, 6000), (1, 3, 12, 5000)], "query_id long, rank int, passage_id long, n_chars long")
    assert [r.kept for r in retrieve.context_budget(rows).orderBy("rank").collect()] == [True, False, True]


def test_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (6, 7)], "src long, dst long")
    assert sorted(r.id for r in context.on_cycles(e).collect()) == [1, 2, 3, 5]
    assert context.on_cycles(e.limit(0)).count() == 0


def test_overlap_uses_the_last_valid_span(spark):
    b = spark.createDataFrame([("d", 1, 1, 1, 5), ("d", 2, 1, 90, 99), ("d", 3, 1, 5, 6), ("d", 4, 1, 7, 8)], "document_id string, ordinal int, page_number int, line_start int, line_end int")
    pages = spark.createDataFrame([("d", 1, 10)], "document_id string, page_number int, n_lines int")
    assert sorted((r.rule, r["where"]) for r in context.span_findings(b, pages).collect()) == [("overlap", "d#3"), ("span", "d#2")]


def test_fold_policy(spark):
    rows = [(1, 0, "ATTEMPT", "D2", False, True), (1, 1, "ATTEMPT", "D2", False, True), (1, 2, "ATTEMPT", "D2", False, True), (1, 3, "HELP", "UNCLEAR", False, True), (1, 4, "ATTEMPT", "CORRECT", False, True), (1, 5, "VAGUE", "UNCLEAR", False, True)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, turn_type string, diagnosis string, correct boolean, delivered boolean")
    got = [(r.action, r.help_level) for r in tutor.folded(t).orderBy("turn").collect()]
    assert got == [("redirect", 1), ("redirect", 2), ("explain", 3), ("explain", 3), ("confirm", 3), ("wrap_up", 3)]


def test_undelivered_actions_leave_the_state(spark):
    t = spark.createDataFrame([(1, 0, "HELP", "UNCLEAR", False, False), (1, 1, "HELP", "UNCLEAR", False, True)], "conv_id long, turn long, turn_type string, diagnosis string, correct boolean, delivered boolean")
    assert [r.action for r in tutor.folded(t).orderBy("turn").collect()] == ["hint", "hint"]


def test_rule_levels(spark):
    rows = spark.createDataFrame([("definition", "limit", "what a limit is", "a limit is defined as a value"), ("definition", "limit", "x", "nothing here"), ("formula_statement", "∫ x dx", "x", "we know \\int x dx = 1"), ("course_policy", None, "grading homework rules", "homework grading rules apply")], "t string, a string, d string, b string")
    none = F.array().cast("array<string>")
    got = [r[0] for r in rows.select(ground.rule_level(F.col("t"), F.col("a"), F.col("d"), none, F.col("b"))).collect()]
    assert got == ["covered", "not_covered", "covered", "partially_covered"]


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "store")
    a = spark.createDataFrame([("r1", 1)], "record_id string, v int")
    assert sinks.write_once(a, path) == 1
    with pytest.raises(ValueError):
        sinks.write_once(a, path)


def test_gated_publish(spark, tmp_path):
    path = str(tmp_path / "out")
    good, bad = spark.range(3), spark.range(5)
    f = spark.createDataFrame([("warning",)], "severity string")
    assert sinks.publish(good, f, path)
    assert not sinks.publish(bad, spark.createDataFrame([("error",)], "severity string"), path)
    assert spark.read.parquet(path).count() == 3


def test_uploads(spark, tmp_path):
    (tmp_path / "Notes One.txt").write_bytes(b"Lecture 1\nx\xff")
    (tmp_path / "odd.bin").write_bytes(b"?")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p/></w:body></w:document>')
    (tmp_path / "a.docx").write_bytes(data.getvalue())
    got = {r.filename: r for r in readers.uploads(spark, str(tmp_path)).collect()}
    assert got["Notes One.txt"].document_id == "notes-one" and got["Notes One.txt"].body == "Lecture 1\nx�"
    assert got["a.docx"].body == "Hello\n" and got["odd.bin"].status == "failed"


def test_last_by_key(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, i int, v string")
    assert sorted((r.k, r.v) for r in readers.last_by_key(rows, "k", "i").collect()) == [("a", "y"), ("b", "z")]


def test_encoder_double(spark):
    df = spark.createDataFrame([("a b",), ("a b",), (None,)], "x string").select(ports.encoder()("x").alias("v")).collect()
    assert df[0].v == df[1].v and len(df[0].v) == 64


def test_vector_takes_a_large_query_set(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 7)
    vecs = {i: None if i == 9 else [1.0, 0.5] if i == 11 else [float(i % 5), float(i % 3), 1.0] for i in range(60)}
    q = spark.createDataFrame([(i, v) for i, v in vecs.items() if i % 2 == 0], "query_id long, q_vec array<float>")
    r = spark.createDataFrame(list(vecs.items()), "record_id long, r_vec array<float>")
    out = retrieve.vector(q, r, 4)
    assert "BroadcastNestedLoopJoin BuildRight, Inner, NOT" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(x.query_id, x["rank"]): (x.record_id, x.similarity) for x in out.collect()}
    sim = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)), 9)
    for i in range(0, 60, 2):
        near = sorted((-sim(vecs[i], v), j) for j, v in vecs.items() if j != i and j not in (9, 11))[:4]
        assert [got.pop((i, n)) for n in range(1, 5)] == [(j, -s) for s, j in near]
    assert not got
    some = r.where("record_id IN (0, 9, 11)")
    null = q.where("query_id = 2").select("query_id", F.lit(None).cast("array<float>").alias("q_vec"))
    assert [(x.record_id, x.similarity) for x in retrieve.vector(null, some).orderBy("rank").collect()] == [(0, None), (9, None), (11, None)]
    assert [(x.record_id, x.similarity) for x in retrieve.vector(q.where("query_id = 2"), some).orderBy("rank").collect()] == [(0, 1.0), (9, None), (11, None)]


def test_vector_query_takes_every_twentieth_row(spark):
    assert "r04_vector_top40_each20" in QUERIES
    got = QUERIES["r04_vector_top40_each20"](spark, "/root/testdata/sf0.001").select("query_id").distinct().collect()
    ids = {r.vec_id for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()}
    assert {r.query_id for r in got} == {i for i in ids if i % 20 == 0}


def test_facets_reserve_passages(spark):
    rows = [(1, 0, 10, 1), (1, 0, 11, 2), (1, 1, 11, 1), (1, 1, 12, 2), (1, 1, 13, 3), (1, 2, 12, 1), (2, 1, 10, 2)]
    ranked = spark.createDataFrame(rows, "query_id long, facet_no long, passage_id long, rank int")
    got = {tuple(r) for r in retrieve.reserved(ranked).collect()}
    assert got == {(1, 10, 1, 0), (1, 11, 1, 1), (1, 12, 1, 2), (2, 10, 2, 1)}
    assert "r08_reserved_facets" in QUERIES
