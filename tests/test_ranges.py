"""Range joins, as-of joins and paths against plain searches; odd rows."""

import random

from lectern.operators import context, ranges


def test_points_inside_spans_of_any_length(spark):
    r = random.Random(2)
    spans = []
    for i in range(120):
        start = r.randrange(-200, 5000)
        spans.append((i, r.choice(["a", "a", "a", "b", None]), start, start + r.choice([-1, 0, 1, 7, 8, 300, 5000])))
    spans.append((999, "a", -(10**9), 10**9))
    points = [(r.choice(["a", "a", "b", None]), r.choice([None, *range(-200, 5000, 7)]), j) for j in range(400)]
    s = spark.createDataFrame(spans, "id int, k string, s long, e long")
    p = spark.createDataFrame(points, "k string, at long, no int")
    want = sorted((i, no) for i, k, a, b in spans for pk, at, no in points if k is not None and k == pk and at is not None and a <= at <= b)
    assert sorted((x.id, x.no) for x in ranges.inside(s, p, "k", "s", "e", "at").collect()) == want
    left = {x.id for x in ranges.without(s, p, "k", "s", "e", "at", "id").collect()}
    assert left == {i for i, *_ in spans} - {i for i, _ in want}
    assert ranges.inside(s.limit(0), p, "k", "s", "e", "at").count() == 0 and ranges.inside(s, p.limit(0), "k", "s", "e", "at").count() == 0


def test_last_row_before(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", None]), r.choice([None, *range(0, 900)])) for i in range(300)]
    others = [(r.choice(["a", "a", "b", None]), r.choice([None, *range(100, 800, 3)]), j) for j in range(150)]
    left, right = spark.createDataFrame(rows, "id int, k string, at long"), spark.createDataFrame(others, "k string, at long, no int")
    for cells in (1, 7, 1024):
        got = {x.id: x.last and (x.last["at"], x.last.no) for x in ranges.last_before(left, right, "k", "at", "last", cells).collect()}
        for i, k, at in rows:
            fit = [(t, no) for key, t, no in others if key is not None and key == k and t is not None and at is not None and t <= at]
            assert got[i] == max(fit, default=None), (cells, i)
    assert {x.last for x in ranges.last_before(left, right.limit(0), "k", "at", "last").collect()} == {None}


def test_paths_of_deep_trees_cycles_and_orphans(spark):
    chain = [(0, None, "t0"), *[(i, i - 1, f"t{i}") for i in range(1, 150)]]
    more = [(500, 501, "x"), (501, 500, "y"), (502, 500, "below"), (600, 999, "orphan"), (601, 600, "o2"), (700, None, "alone")]
    found = {r.id: r.path for r in context.paths(spark.createDataFrame(chain + more, "id int, parent_id int, title string")).collect()}
    assert found == {**{i: " > ".join(f"t{j}" for j in range(i + 1)) for i in range(150)}, 700: "alone"}
    assert context.paths(spark.createDataFrame([], "id int, parent_id int, title string")).count() == 0
