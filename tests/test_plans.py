"""Finalised plans by hand-made cases, config layers, and functions without a query."""

import pytest

from lectern.functions import fixed
from lectern.plans import drafts
from lectern.sources import readers


KNOWN = [1, 2, 3, 4, 5, 6, 7, 8]
_SCHEMA_CONCEPT, _LINKED = [(1, "chain rule", "m1", "question_schema", "primary")], [(2, "limits", "m1", "linked", "primary"), (3, "series", "m1", "linked", "related")]
_NEED = ("definition", "What is a limit?", None, None)


def plan_of(spark, draft, concept_id, related=(), query="a query", needs=(_NEED,), drafted_needs=None):
    """(status, query, concepts, needs, repairs) of one proposal over one draft."""
    c = "array<struct<concept_id:bigint,name:string,module_id:string,source:string,role:string>>"
    n = "array<struct<need_id:string,need_type:string,query:string,anchor:string,concept_id:bigint>>"
    drafts_ = spark.createDataFrame([(1, list(draft), "from the draft", drafted_needs)], f"turn_id long, concepts {c}, main_query string, needs {n}")
    asked = "array<struct<need_type:string,description:string,anchor:string,concept_id:bigint>>"
    made = spark.createDataFrame([(1, concept_id, list(related) or None, query, list(needs))], f"turn_id long, concept_id long, related_ids array<bigint>, query string, needs {asked}")
    r = drafts.plan.finalized(made, drafts_, spark.createDataFrame([(i,) for i in KNOWN], "concept_id long")).first()
    return r.concept_status, r.main_query, [(x.concept_id, x.source, x.role) for x in r.concepts], [tuple(x) for x in r.needs], list(r.repairs)


PLANS = {
    "as proposed": (dict(draft=[], concept_id=2, related=[3]), ("found", "a query", [(2, "model", "primary"), (3, "model", "related")], [("definition", "What is a limit?", None, 2)], [])),
    "question schema stays": (
        dict(draft=_SCHEMA_CONCEPT, concept_id=2),
        ("found", "a query", [(1, "question_schema", "primary"), (2, "model", "related")], [("definition", "What is a limit?", None, 1)], ["concept_id question_schema_kept_primary"]),
    ),
    "unknown ones go": (
        dict(draft=[], concept_id=99, related=[98, 3]),
        ("found", "a query", [(3, "model", "primary")], [("definition", "What is a limit?", None, 3)], ["concept_id unknown_concept_dropped", "related_concept_ids unknown_concept_dropped", "related_concept_ids first_related_promoted_to_primary"]),
    ),
    "the draft's concepts": (
        dict(draft=_LINKED, concept_id=99, related=[4]),
        ("found", "a query", [(2, "linked", "primary"), (3, "linked", "related"), (4, "model", "related")], [("definition", "What is a limit?", None, 2)], ["concept_id unknown_concept_dropped", "concept_id concepts_from_draft"]),
    ),
    "not in the course": (dict(draft=_LINKED, concept_id=-1), ("not_in_course", "a query", [], [("definition", "What is a limit?", None, None)], [])),
    "but the question is": (
        dict(draft=_SCHEMA_CONCEPT, concept_id=-1),
        ("found", "a query", [(1, "question_schema", "primary")], [("definition", "What is a limit?", None, 1)], ["concept_id not_in_course_ignored"]),
    ),
    "nothing at all": (dict(draft=[], concept_id=None, query=" ", needs=[]), ("none_found", "from the draft", [], [], ["query main_query_from_draft", "evidence_needs needs_from_draft"])),
    "needs repaired": (
        dict(draft=[], concept_id=2, needs=[("poem", "Write one", None, None), ("definition", " ", None, None), ("definition", "a limit", " the  word ", 7), ("definition", "A LIMIT", None, None)]),
        (
            "found", "a query", [(2, "model", "primary")], [("definition", "a limit", "the  word", 2)],
            ["evidence_needs[0] invalid_need_dropped", "evidence_needs[1] empty_need_dropped", "evidence_needs[2] not_a_plan_concept_dropped", "evidence_needs[3] duplicate_dropped"],
        ),
    ),
    "needs of the draft": (
        dict(draft=_LINKED, concept_id=2, needs=[("poem", "x", None, None)], drafted_needs=[("n1", "definition", "Definition of limits", "limits", 2)]),
        ("found", "a query", [(2, "model", "primary")], [("definition", "Definition of limits", "limits", 2)], ["evidence_needs[0] invalid_need_dropped", "evidence_needs needs_from_draft"]),
    ),
}


@pytest.mark.parametrize("name", PLANS)
def test_finalized_plan(spark, name):
    given, want = PLANS[name]
    assert plan_of(spark, **given) == want


def test_limits_of_plans(spark):
    status, query, concepts, needs, repairs = plan_of(spark, _SCHEMA_CONCEPT, 2, [3, 4, 5, 6, 7], "q" * 3000, [("definition", f"need {i} " + "w" * 3000, None, None) for i in range(12)])
    assert sum(r == "related" for _, _, r in concepts) <= fixed.MAX_RELATED and len(concepts) <= fixed.MAX_CONCEPTS and len(needs) == fixed.MAX_NEEDS
    assert len(query) == fixed.MAX_MAIN_CHARS and all(len(n[1]) == fixed.MAX_NEED_CHARS for n in needs)
    assert {"related_concept_ids truncated", "query truncated", "evidence_needs truncated", "evidence_needs[0] truncated"} <= set(repairs)


def test_plans_of_whole_tables(spark):
    """What holds for every plan: one status, known concepts, a primary where concepts were found, limits."""
    sf = "/root/testdata/sf0.01"
    catalog = drafts.catalog(spark, sf)
    known = {r.concept_id for r in catalog.collect()}
    drafted = drafts.plan.drafted(drafts.contexts(spark, sf), catalog)
    got = drafts.plan.finalized(drafts.proposals(spark, sf), drafted, catalog).collect()
    assert len(got) == drafts.proposals(spark, sf).join(drafted, "turn_id").count() > 0
    for r in got:
        primary = [c.concept_id for c in r.concepts if c.role == "primary"]
        assert {c.concept_id for c in r.concepts} <= known and len(r.concepts) == len({c.concept_id for c in r.concepts}) <= fixed.MAX_CONCEPTS
        assert (r.concept_status == "found") == bool(primary) and len(r.needs) <= fixed.MAX_NEEDS and r.main_query
        assert all(n.need_type in fixed.NEED_TYPES for n in r.needs)


def test_layers():
    assert readers.layered({"a": "1", "b": "1"}, {"a": "2", "b": None}, {"c": "3"}) == {"a": "2", "b": "1", "c": "3"}
