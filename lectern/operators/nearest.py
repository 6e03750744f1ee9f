"""Exact nearest records by dot product over an inverted file of cells.

Centroids are fitted on a bounded sample (SAMPLE records, those with the least hashes). Every record goes to the cell of its nearest centroid; a cell knows its
radius. For a query q and a record x of a cell with centroid c and radius r, q.x <= q.c + |q| r, so a query first searches the cells with the greatest bounds
until they hold k records, which gives it a k-th similarity; of the other cells it searches only those whose bound reaches that. The result is exact whatever the
sample: a bad fit only prunes less. Large cells are cut into blocks of BLOCK records, so a cell that holds a third of all rows is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import fixed
from ..staging import staged
from .retrieve import _matrix, _nearest, top

#: Records that centroids are fitted on, at most; cells, at most; records of a block; queries of a block.
SAMPLE, CELLS, BLOCK, ASKED = 16_384, 1_024, 16_384, 1_024
#: Queries of a cell that meet a block in one task; rows that are held against all centroids at a time.
MEET, ROWS = 16_384, 512
#: Similarities are rounded to nine places, so bounds get as much room.
_ROOM = 2e-9


def _vectors(col: pa.Array | pa.ChunkedArray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column in double precision, and which of them are whole vectors of d finite numbers; the others are zeros."""
    x, ok = _matrix(col if isinstance(col, pa.ChunkedArray) else pa.chunked_array([col]), d)
    ok &= np.isfinite(x).all(1) & (d > 0)
    x[~ok] = 0.0
    return x, ok


def fitted(records: DataFrame, steps: int = 8, sample: int = SAMPLE, cells: int = CELLS) -> np.ndarray:
    """Centroids, about a root of as many as there are records, from the records with the least hashes."""
    usable = records.where("r_vec IS NOT NULL AND size(r_vec) > 0")
    n = usable.count()
    held = usable.orderBy(F.xxhash64("record_id"), "record_id").limit(sample).select("r_vec").toPandas()["r_vec"]
    sizes = held.map(len)
    d = int(sizes.mode().max()) if len(held) else 0
    x, ok = _vectors(pa.array(held[sizes == d].map(list)) if len(held) else pa.array([], pa.list_(pa.float64())), d)
    x = x[ok]
    if not len(x):
        return np.zeros((0, d))
    k = max(1, min(cells, int(n**0.5), len(x)))
    at = np.random.default_rng(5).choice(len(x), k, replace=False)
    c = x[at].copy()
    for _ in range(steps):
        own = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        total, count = np.zeros_like(c), np.bincount(own, minlength=k)
        np.add.at(total, own, x)
        c[count > 0] = total[count > 0] / count[count > 0, None]
    return c


def assigned(records: DataFrame, centroids: np.ndarray) -> DataFrame:
    """records with cell (-1: no whole vector of the centroids' length) and dist, the distance to its centroid."""
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in records.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ok = _vectors(batch.column("r_vec"), centroids.shape[1])
            near = [((centroids * centroids).sum(1) - 2 * x[i : i + ROWS] @ centroids.T).argmin(1) for i in range(0, len(x), ROWS)] if len(centroids) else []
            cell = np.where(ok, np.concatenate(near), -1) if near else np.full(len(x), -1)
            dist = np.where(cell >= 0, np.linalg.norm(x - centroids[np.maximum(cell, 0)], axis=1) if len(centroids) else 0.0, 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(dist, pa.float64())], schema=pa.schema([*kinds, ("cell", pa.int32()), ("dist", pa.float64())]))

    return records.mapInArrow(run, StructType([*records.schema.fields, *StructType.fromDDL("cell int, dist double").fields]))


def _chosen(queries: DataFrame, centroids: np.ndarray, cells: list[tuple[int, float, int]], k: int, known: bool) -> DataFrame:
    """queries with the cells each has to search: the best until they hold k records, or (`known`) the others that may reach `least`.

    A query that isn't a whole vector of the centroids' length searches every cell.
    """
    ids, radius, size = (np.array(c) for c in zip(*sorted(cells), strict=True)) if cells else (np.zeros(0, int), np.zeros(0), np.zeros(0, int))
    real = ids >= 0
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in queries.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, len(whole), ROWS)):
            q, ok = _vectors(batch.column("q_vec"), centroids.shape[1])
            bound = np.full((len(q), len(ids)), -np.inf)
            bound[:, real] = q @ centroids[ids[real]].T + np.linalg.norm(q, axis=1)[:, None] * radius[real] * (1 + 1e-12) + _ROOM
            order = np.argsort(-bound, axis=1, kind="stable")
            lists = []
            least = batch.column("least").to_pylist() if known else [None] * len(q)
            for i in range(len(q)):
                # one record may be the query itself
                first = int(np.searchsorted(np.cumsum(size[order[i]]), k + 1)) + 1
                if not ok[i]:
                    lists.append(ids[:0] if known else ids)
                elif not known:
                    lists.append(ids[order[i][:first]])
                else:
                    rest = order[i][first:]
                    lists.append(ids[rest[(bound[i][rest] >= least[i]) | ~real[rest]] if least[i] is not None else rest])
            ends = np.cumsum([0, *map(len, lists)])
            cells_ = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists), pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells_], schema=pa.schema([*kinds, ("cells", pa.list_(pa.int32()))]))

    return queries.mapInArrow(run, StructType([*queries.schema.fields, *StructType.fromDDL("cells array<int>").fields]))


def _searched(asked: DataFrame, blocks: DataFrame, sizes: DataFrame, k: int, shares: int) -> DataFrame:
    """The k nearest records of each query in each block of each cell it searches; queries are dealt in `shares`, so that a task's queries are bounded as its records are."""
    kinds = {"query_id": asked.schema["query_id"].dataType, "record_id": blocks.schema["record_id"].dataType, "similarity": DoubleType()}
    schema = pa.schema([(n, to_arrow_type(t)) for n, t in kinds.items()])
    each = asked.select("query_id", "q_vec", F.explode("cells").alias("cell")).join(sizes, "cell")
    each = each.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("share", F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int"))
    copies = blocks.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    near = each.groupBy("cell", "part", "share").cogroup(copies.groupBy("cell", "part", "share"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = [_nearest(a.slice(i, ASKED), b, k, schema) for i in range(0, len(a), ASKED)] if len(b) else []
        return pa.concat_tables([schema.empty_table(), *found])

    return near.applyInArrow(run, StructType([StructField(n, t) for n, t in kinds.items()]))


def nearest(queries: DataFrame, records: DataFrame, k: int = fixed.CANDIDATES) -> DataFrame:
    """(query_id, record_id, similarity, rank): the k records with the greatest dot product, as `retrieve.vector` gives them, cells that cannot matter left out."""
    queries, records = queries.where("query_id IS NOT NULL"), records.where("record_id IS NOT NULL")
    centroids = fitted(records)
    shares = max(1, -(-queries.count() // MEET))
    held = staged(assigned(records, centroids), "cells")
    per = held.groupBy("cell").agg(F.max("dist").alias("radius"), F.count(F.lit(1)).alias("n"))
    cells = [tuple(r) for r in per.collect()]  # CELLS + 1 rows at most
    sizes = per.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    blocks = held.join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("record_id"), F.col("parts")).cast("int")).select("cell", "part", "record_id", "r_vec")
    first = staged(_searched(_chosen(queries, centroids, cells, k, False), blocks, sizes, k, shares), "near")
    kth = top(first, ["query_id"], [F.desc("similarity"), F.col("record_id")], k).groupBy("query_id").agg(F.when(F.count("similarity") == k, F.min("similarity")).alias("least"))
    more = _searched(_chosen(queries.join(kth, "query_id", "left"), centroids, cells, k, True), blocks, sizes, k, shares)
    return top(first.unionByName(more), ["query_id"], [F.desc("similarity"), F.col("record_id")], k)
