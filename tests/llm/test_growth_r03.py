"""Steps of training-data operators that took too many jobs (findings of round 3)."""

import random

import pytest

from lectern.llm import common


@pytest.fixture
def written(monkeypatch):
    """The tags of the tables that are written."""
    tags, plain = [], common.staged

    def staged(df, tag):
        tags.append(tag)
        return plain(df, tag)

    monkeypatch.setattr(common, "staged", staged)
    return tags


def smallest(pairs):
    to = {x: x for p in pairs for x in p}
    while any(to[a] != to[b] for a, b in pairs):
        for a, b in pairs:
            to[a] = to[b] = min(to[a], to[b])
    return to


def test_components_of_a_forest_take_one_round(spark, written):
    pairs = [(i, 1 + i % 3) for i in range(10, 300)] + [(2, 1)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == smallest(pairs) and len(written) <= 4


@pytest.mark.parametrize("seed", range(4))
def test_later_edges_are_added_to_components(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(45)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    by = None
    for part in (pairs[:15], [], pairs[15:30], pairs[30:]):
        by = common.merged(frame(part), by)
    got = [(x.id, x.component) for x in by.collect()]
    assert dict(got) == {k: v for k, v in smallest(pairs).items() if k != v} and len(got) == len(dict(got))
