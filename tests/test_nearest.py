"""The pruned search against comparing everything; odd vectors; how much is pruned."""

import numpy as np

from lectern.operators import nearest, retrieve


def frames(spark, vectors, step=5):
    rows = [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in enumerate(vectors)]
    r = spark.createDataFrame(rows, "record_id long, r_vec array<double>")
    return r.where(f"record_id % {step} = 0").withColumnsRenamed({"record_id": "query_id", "r_vec": "q_vec"}), r


def same(a, b):
    key = lambda df: sorted((r.query_id, r["rank"], r.record_id, repr(r.similarity)) for r in df.collect())
    return key(a) == key(b)


def test_equals_comparing_everything(spark):
    g = np.random.default_rng(1)
    centres = g.normal(size=(12, 8))
    x = [list(centres[i % 12] + g.normal(size=8) * 0.05) for i in range(400)]
    x += [x[0]] * 30 + [[0.0] * 8, None, [], [1.0] * 3, [1.0, None] + [0.0] * 6]  # copies, no vectors, other lengths
    q, r = frames(spark, x)
    assert same(nearest.nearest(q, r, 7), retrieve.vector(q, r, 7))


def test_few_records_and_none(spark):
    q, r = frames(spark, [[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]], 1)
    assert same(nearest.nearest(q, r, 40), retrieve.vector(q, r, 40))
    assert nearest.nearest(q, r.limit(0), 40).count() == 0 and nearest.nearest(q.limit(0), r, 40).count() == 0


def test_cells_that_cannot_matter_are_left_out(spark):
    g = np.random.default_rng(2)
    centres = g.normal(size=(30, 16)) * 3
    q, r = frames(spark, [list(centres[i % 30] + g.normal(size=16) * 0.02) for i in range(900)], 10)
    c = nearest.fitted(r)
    cells = [tuple(x) for x in nearest.assigned(r, c).groupBy("cell").agg({"dist": "max", "*": "count"}).select("cell", "max(dist)", "count(1)").collect()]
    kth = retrieve.vector(q, r, 10).groupBy("query_id").agg({"similarity": "min"}).withColumnRenamed("min(similarity)", "least")
    visited = [len(x.cells) for d, known in ((q, False), (q.join(kth, "query_id"), True)) for x in nearest._chosen(d, c, cells, 10, known).collect()]
    assert sum(visited) < 0.3 * 90 * len(cells)
