"""Near-duplicate embeddings by cross-polytope hashing.

Each table turns a unit vector by rounds of random signs and a fast Hadamard transform and names the nearest vertex of the
cross-polytope: the largest coordinate and its sign. A bucket joins two such names. A vector also visits its
next-best buckets (the runners-up of each polytope); of random pairs at cosine 0.9 exactly, 3 of 20,000 shared none of the tables
at 64 dimensions, 2 of 20,000 at 128 and 14 of 6,000 at 384. Inside a bucket, vectors are compared exactly, block by block, so a
bucket with many members is dealt out as pairs of blocks; a pair is counted in the first of its common buckets only.
Equal vectors are one class with a count. Only counts and a spanning set of links leave a block, never all pairs.

Nulls and edge cases: null vectors, zero vectors and those with null, infinite or NaN components link with nothing, as do
vectors of another length; rows with one vec_id and one vector are a class like any other (each counts the others); an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, mix64, staged

TABLES, TURNS = 12, 3
#: Ranks of the two polytopes' vertices whose buckets a vector visits; the first pair is its own bucket.
VISITS = ((0, 0), (1, 0), (0, 1), (1, 1))
#: Members of a block; groups up to SMALL are compared pair by pair, larger ones by matrix products.
BLOCK, SMALL = 512, 48
_RANKS = 1 + max(map(max, VISITS))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows whose length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2)
        h *= 2
    return x.reshape(n, d) / np.sqrt(d)


def signs(table: int, polytope: int, turn: int, d: int) -> np.ndarray:
    seed = np.uint64(((table * 64 + polytope) * 64 + turn) << 32)
    return np.where(mix64(np.arange(1, d + 1, dtype=np.uint64) + seed) & np.uint64(1), 1.0, -1.0)


def vertices(x: np.ndarray, table: int, polytope: int) -> np.ndarray:
    """The nearest _RANKS vertices of every row, nearest first."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    y = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    for turn in range(TURNS):
        y = hadamard(y * signs(table, polytope, turn, d))
    at = np.argpartition(-np.abs(y), _RANKS - 1, axis=1)[:, :_RANKS]
    size = np.take_along_axis(y, at, 1)
    order = np.argsort(-np.abs(size), axis=1, kind="stable")
    at, size = np.take_along_axis(at, order, 1), np.take_along_axis(size, order, 1)
    return (at * 2 + (size < 0)).astype(np.int64)


def buckets(x: np.ndarray) -> np.ndarray:
    """(rows, TABLES, len(VISITS)) bucket numbers, of the dimension, the table and both polytopes' vertices; the first is the vector's own."""
    out = np.empty((len(x), TABLES, len(VISITS)), np.int64)
    for t in range(TABLES):
        one, two = vertices(x, t, 0), vertices(x, t, 1)
        for v, (i, j) in enumerate(VISITS):
            out[:, t, v] = (((x.shape[1] % 4096) << 6 | t) << 44) | one[:, i] << 22 | two[:, j]
    return out


def usable(v: list | None) -> bool:
    if not v or any(c is None for c in v):
        return False
    x = np.asarray(v, np.float64)
    return bool(np.isfinite(x).all() and x.any())


def units(raw: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors in double precision from vectors of one dimension."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def classed(vectors: DataFrame, kind: str) -> DataFrame:
    """(vec_id, digest, x): the vector's bytes and the digest of its direction, null where it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.asarray(v, kind).tobytes() if usable(v) else None for v in batch.column(1).to_pylist()]
            digest = [None if r is None else xxhash.xxh3_128_digest(units([r], kind).tobytes()) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "digest", "x"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, digest binary, x binary")


def visited(classes: DataFrame, kind: str) -> DataFrame:
    """(bucket, id, times, own, x) for every bucket that a class visits."""
    size = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            lengths = np.array([len(r) // size for r in raw])
            for d in np.unique(lengths):
                mine = np.flatnonzero(lengths == d)
                for part in np.array_split(mine, -(-len(mine) // 256)):
                    b = buckets(units([raw[i] for i in part], kind))
                    own = np.zeros(b.shape, bool)
                    own[:, :, 0] = True
                    each = pa.array(np.repeat(part, b[0].size))
                    yield pa.RecordBatch.from_arrays([pa.array(b.ravel()), batch.column(0).take(each), batch.column(1).take(each), pa.array(own.ravel()), batch.column(2).take(each)], ["bucket", "id", "times", "own", "x"])

    return classes.select("id", "times", "x").mapInArrow(run, "bucket long, id long, times long, own boolean, x binary")


def _first_common(ba: np.ndarray, bb: np.ndarray) -> np.ndarray:
    """The bucket in which a pair is counted: the least of its first table's buckets that one owns and the other visits."""
    none = np.iinfo(np.int64).max
    out = np.full(len(ba), none)
    for t in range(TABLES):
        left = np.flatnonzero(out == none)
        if not len(left):
            break
        a, b = ba[left, t], bb[left, t]
        own_a = np.where((b == a[:, :1]).any(1), a[:, 0], none)
        own_b = np.where((a == b[:, :1]).any(1), b[:, 0], none)
        out[left] = np.minimum(own_a, own_b)
    return out


def _close(x: np.ndarray, group: np.ndarray, own: np.ndarray, side: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group, of both sides where the group has two (side: -1 for one block, else 0 or 1), one of them owner, at cosine `least`."""
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(start, len(group)))
    small = np.repeat(size <= SMALL, size)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for k in range(1, SMALL):
        i = np.flatnonzero((group[k:] == group[:-k]) & small[k:] & (own[k:] | own[:-k]) & ((side[k:] < 0) | (side[k:] != side[:-k])))
        if not len(i) and k >= size[size <= SMALL].max(initial=0):
            break
        for part in np.array_split(i, -(-len(i) // 20_000)) if len(i) else []:
            near = part[np.einsum("ij,ij->i", x[part], x[part + k]) >= least]
            found.append((near, near + k))
    for s, n in zip(start[size > SMALL], size[size > SMALL], strict=True):
        at = np.arange(s, s + n)
        rows, cols = (at, at) if side[s] < 0 else (at[side[at] == 0], at[side[at] == 1])
        if len(rows) and len(cols):
            i, j = np.nonzero(x[rows] @ x[cols].T >= least)
            i, j = rows[i], cols[j]
            ok = (own[i] | own[j]) & ((i < j) | (side[s] >= 0))
            found.append((i[ok], j[ok]))
    i, j = (np.concatenate(c) for c in zip(*found, strict=True))
    return i, j


def _links(batch: pa.Table, least: float, kind: str) -> Iterator[pa.RecordBatch]:
    """Counts and spanning links of whole groups (bucket, low, high), sorted by these."""
    cols = {c: batch.column(c).to_numpy() for c in ("bucket", "id", "times", "own", "block", "low", "high")}
    raw = np.array(batch.column("x").to_pylist(), object)
    dims = cols["bucket"] >> 50
    for d in np.unique(dims):
        pick = np.flatnonzero(dims == d)
        bucket, ids, times, own, block, low, high = (c[pick] for c in cols.values())
        x = units(list(raw[pick]), kind)
        group = np.cumsum(np.concatenate([[False], (bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
        i, j = _close(x, group, own, np.where(low == high, -1, (block == high).astype(np.int64)), least)
        ok = ids[i] != ids[j]
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        used, back = np.unique(np.concatenate([i, j]), return_inverse=True)
        known, of = np.unique(ids[used], return_index=True)
        names = np.concatenate([buckets(x[used[p]]) for p in np.array_split(of, -(-len(of) // 2048))])[np.searchsorted(known, ids[used])]
        bi, bj = back[: len(i)], back[len(i) :]
        step = 1 << 16
        mine = np.concatenate([_first_common(names[bi[s : s + step]], names[bj[s : s + step]]) == bucket[i[s : s + step]] for s in range(0, len(i), step)])
        i, j = i[mine], j[mine]
        n = np.bincount(i, times[j], len(ids)).astype(np.int64) + np.bincount(j, times[i], len(ids)).astype(np.int64)
        root = np.arange(len(ids))
        while True:  # the least row that each can reach, all pairs at once
            new = root.copy()
            np.minimum.at(new, i, root[j])
            np.minimum.at(new, j, root[i])
            new = new[new]
            if (new == root).all():
                break
            root = new
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[root[at]]), pa.array(n[at])], ["a", "b", "n"])


def linked(tasks: DataFrame, least: float, kind: str) -> DataFrame:
    """(a, b, n) from members sorted by (bucket, low, high) within partitions: a's links counted here, and a link of a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def last_group(t: pa.Table) -> int:
            keys = [t.column(c).to_numpy() for c in ("bucket", "low", "high")]
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            return int(np.argmax(same))

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 20_000:
                t = pa.Table.from_batches(held)
                cut = last_group(t)
                if cut:
                    yield from _links(t.slice(0, cut), least, kind)
                rest = t.slice(cut).combine_chunks()
                held, rows = rest.to_batches(), rest.num_rows if rest.num_rows < 20_000 else 0
        if held and sum(b.num_rows for b in held):
            yield from _links(pa.Table.from_batches(held), least, kind)

    return tasks.mapInArrow(run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding)."""
    element = vectors.schema["embedding"].dataType.elementType.typeName()
    kind = "<f4" if element == "float" else "<f8"
    rows = staged(classed(vectors, kind), "vectors")
    classes = staged(rows.where("digest IS NOT NULL AND vec_id IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("times"), F.min("x").alias("x")), "classes")
    visits = visited(classes, kind)
    large = staged(visits.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "large")
    members = visits.join(large, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    members = members.withColumn("block", F.pmod(F.xxhash64("id", "bucket"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = members.select("bucket", "id", "times", "own", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "x")
    tasks = tasks.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "id")
    links = staged(linked(tasks, least, kind), "links")
    by = components(links.select("a", "b"))
    counts = links.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    of_class = classes.select("digest", "id", "times").join(counts, "id", "left").join(by, "id", "left").select("digest", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.drop("x").join(of_class, "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
