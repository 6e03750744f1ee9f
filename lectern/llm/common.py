"""Shared plumbing of the training-data operators: staged tables, exact distributed ranks, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..staging import shared_dir, staged

__all__ = ["HashedWords", "components", "dropped", "exact_rank", "fresh", "keyed", "merged", "mix64", "numbered", "octets", "released", "shared_dir", "staged"]


def dropped(*dfs: DataFrame) -> None:
    """Deletes the files of staged tables that nothing reads any more."""
    for df in dfs:
        spark = df.sparkSession
        top = shared_dir(spark)
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            if path.toUri().getPath().startswith(spark._jvm.org.apache.hadoop.fs.Path(top).toUri().getPath() + "/"):
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits each depend on every input bit (the murmur3 finalizer)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def octets(col: pa.ChunkedArray | pa.Array, step: int = 256) -> Iterator[bytes | None]:
    """UTF-8 bytes of a string column, copied out of the batch a few rows at a time."""
    kind = pa.binary() if pa.types.is_string(col.type) else pa.large_binary()
    for i in range(0, len(col), step):
        yield from col.slice(i, step).cast(kind).to_pylist()


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function of batches; when it ends, its worker, which Spark keeps for other tasks, gives the memory that is free back to the machine."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library

    return runs


class HashedWords(dict):
    """word -> 64-bit hash; cleared when it has grown to `bound` words. Words of over 256 bytes are hashed anew each time."""

    def __init__(self, seed: int = 0, bound: int = 200_000):
        super().__init__()
        self.seed, self.bound = seed, bound

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(word) > 256:
            return xxhash.xxh3_64_intdigest(word, self.seed)
        if len(self) >= self.bound:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def exact_rank(df: DataFrame, strata: list[str], bucket: Column, order: list[Column], name: str = "rank", weight: str | None = None) -> DataFrame:
    """Adds `name`: the 0-based rank of each row in its stratum, by bucket and then by `order` (with `weight`: the weights before it).

    `bucket` must not decrease with the wanted order. No stratum is gathered anywhere: rows are numbered inside
    (stratum, bucket), and the buckets' counts, which are combined before the shuffle, give the offsets.
    """
    df = df.withColumn("_bucket", bucket)
    keys = [*strata, "_bucket"]
    counts = df.groupBy(*keys).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
    before = Window.partitionBy(*strata).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy(*order)
    numbered = df.withColumn("_i", F.coalesce(F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) if weight else F.row_number().over(inside) - 1)
    same = [numbered[k].eqNullSafe(offsets[k]) for k in keys]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    kept = [numbered[c] for c in numbered.columns if c not in ("_i", "_bucket")]
    return numbered.join(offsets, cond).select(*kept, (F.col("_before") + F.col("_i")).cast("long").alias(name))


def numbered(rows: DataFrame, order: list[Column | str]) -> DataFrame:
    """Adds i, each row's place inside its `tree` by `order`, and n, the tree's rows: one sort by range, then offsets of (tree, partition)."""
    keys = [F.col(c).asc_nulls_first() if isinstance(c, str) else c for c in ("tree", *order)]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    ranged = staged(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "sorted")
    tree = Window.partitionBy("tree")
    counts = ranged.groupBy("tree", "_part").agg(F.count(F.lit(1)).alias("m"), F.min("_at").alias("low"))
    before = F.coalesce(F.sum("m").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("tree", "_part", (before - F.col("low")).alias("_by"), F.sum("m").over(tree).alias("n"))
    # sixteen copies of the offsets: a partition's rows are dealt out in stretches
    offsets = offsets.withColumn("_cut", F.explode(F.sequence(F.lit(0), F.lit(15)).cast("array<long>")))
    joined = ranged.withColumn("_cut", F.shiftright("_at", 8) % 16).join(offsets, ["tree", "_part", "_cut"])
    return joined.withColumn("i", F.col("_at") + F.col("_by")).drop("_part", "_cut", "_at", "_by")


def keyed(docs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """docs with the long `name`, and (doc_id, text) with that key as doc_id, once for each key.

    Rows equal in doc_id and text have one key; keys ascend with doc_id, rows of one doc_id by a hash of their texts, and those without doc_id come
    last. Where every row has a doc_id of its own, which one count of ids tells, the key is the doc_id.
    """
    shared = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL")
    if not shared.limit(1).count():
        out = docs.withColumn(name, F.col("doc_id").cast("long"))
        return out, out.select(F.col(name).alias("doc_id"), "text")
    told = F.struct(F.xxhash64("text").alias("h"), F.isnull("text").alias("none"))
    ids = docs.select("doc_id", told.alias("told")).distinct().select(F.lit("").alias("tree"), F.col("doc_id").alias("_id"), F.col("told").alias("_told"))
    ids = staged(numbered(ids, [F.col("_id").asc_nulls_last(), F.col("_told")]).select("_id", "_told", F.col("i").alias(name)), "keys")
    out = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_id"]) & (told == ids["_told"])).drop("_id", "_told")
    return out, out.select(F.col(name).alias("doc_id"), "text").dropDuplicates(["doc_id"])


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it from clashing with a column, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def _between(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, between the components of the ends of edges (a, b), where these differ; an end without a label is its own component."""
    for end in ("a", "b"):
        edges = edges.join(labels.select(F.col("id").alias(end), F.col("component").alias("_to")), end, "left").select(*[F.coalesce("_to", c).alias(c) if c == end else c for c in ("a", "b")])
    return edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _rooted(up: DataFrame) -> DataFrame:
    """The root of every id of a forest (id, component), whose pointers lead to smaller ids: pointers double their reach until none moves."""
    while True:
        above = up.select(F.col("id").alias("component"), F.col("component").alias("above"))
        new = staged(up.join(above, "component", "left").select("id", F.coalesce("above", "component").alias("component"), F.isnotnull("above").alias("moved")), "least")
        dropped(up)
        up = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return up


def merged(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in `edges` (a, b) that is not itself the smallest.

    `known` is the result for earlier edges, to which these are added; the earlier ones are not read again. Every node points at its least
    neighbour if that is smaller than itself, pointers lead on to their roots, and edges between different roots are left for the next round. A node that
    neither points nor is pointed at has only neighbours with smaller roots then, and points next time: so two rounds at least halve
    the nodes that have edges, and a forest takes one. Minima are combined before the shuffle; all tables that are joined are written to
    the shared folder, so that Spark may split the join at a hub with very many.
    """
    edges = edges.select("a", "b")
    now = staged(_between(edges, known) if known is not None else edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while n := now.count():
        up = staged(now.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")), "least")
        whole = up.count() == n  # an edge for each node: all of them are pointers
        up = _rooted(up)
        if known is None:
            known = up
        else:
            moved = known.join(up.select(F.col("id").alias("component"), F.col("component").alias("_to")), "component", "left").select("id", F.coalesce("_to", "component").alias("component"))
            known = staged(moved.unionByName(up), "components")
        if whole:
            dropped(now)
            return known
        new = staged(_between(now.select(F.col("u").alias("a"), F.col("v").alias("b")), up), "edges")
        dropped(now)
        now = new
    return known if known is not None else now.select(F.col("u").alias("id"), F.col("v").alias("component"))


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in `edges` (a, b)."""
    by = merged(edges)
    return by.unionByName(by.select(F.col("component").alias("id"), "component").distinct())
