"""Concept names found by joins, against one regular expression for each name."""

from lectern.operators import segment

NAMES = [("c1", "chain rule"), ("c2", "rule"), ("c3", "x-ray"), ("c4", "the"), ("c5", "a+b"), ("c6", "power series of e"), ("c7", "chain")]


def test_names_by_join_equal_names_by_expression(spark):
    texts = ["The Chain-Rule holds", "chain  \n rule", "chained rules", "an x-ray and an x ray", "X-RAYS", "power series of e.", "a+b or a + b", "", None, "rule_1", "(rule)", "the the THE chain"]
    rows = spark.createDataFrame([(i, None if i % 2 else "Rule of", t) for i, t in enumerate(texts)], "id int, heading string, text string")
    plain = [n for n in NAMES if n[0] != "c5"]
    concepts = spark.createDataFrame([(c, n, i) for i, (c, n) in enumerate(plain)] + [("c8", None, 9), ("c9", " - ", 9)], "concept_id string, name string, ordinal int")
    want = {r.id: r.concept_ids for r in segment.tagged(rows, plain).collect()}
    assert {r.id: r.concept_ids for r in segment.tagged_by(rows, concepts, ["id"]).collect()} == want
    assert {tuple(r.concept_ids) for r in segment.tagged_by(rows, concepts.limit(0), ["id"]).collect()} == {()}
