"""Retrieval: lexical, vector and full-text channels, fusion, budgets.

Candidates come from joins on tokens, so a query meets only the passages that share a term with it. Rankings are total
orders (score, then id), hence the same under any partitioning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import fixed, text
from ..staging import staged

#: A block of queries; records are cut into RECORD_BLOCKS, or more so that a block has RECORD_BLOCK at most on average.
QUERY_BLOCK, RECORD_BLOCKS, RECORD_BLOCK = 2048, 16, 32768
#: Hits in a block of passages on average.
HITS = 1 << 20

def top(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def scored(queries: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, passage_id, n_terms, overlap, score, and the other columns of both) of every query and passage that share a term.

    The score is the number of shared terms over the square root of the passage's number of terms. Terms meet in a hash join; overlaps are summed before the shuffle
    by pair. A passage is cut into terms once: a plain explode would have its size tested first, with the terms written into the test.
    """
    q = queries.withColumn("token", F.explode(text.lexical_terms(F.col("query")))).drop("query")
    keys = ["query_id", "passage_id"]
    own = [c for c in passages.columns if c != "body"]
    extra = [c for c in [*queries.columns, *own] if c not in (*keys, "query")]
    cut = passages.select(*own, text.lexical_terms(F.col("body")).alias("_terms"))
    p = cut.select(*own, F.size("_terms").alias("n_terms"), F.explode_outer("_terms").alias("token"))
    pairs = q.join(p, "token").groupBy(*keys, "n_terms", *extra).agg(F.count(F.lit(1)).alias("overlap"))
    return pairs.withColumn("score", F.col("overlap") / F.sqrt(F.greatest(F.lit(1), F.col("n_terms"))))


def lexical(queries: DataFrame, passages: DataFrame, k: int = fixed.TOP_K, boost: Column | None = None) -> DataFrame:
    """(query_id, passage_id, rank, score, overlap) from (query_id, query, ...) and (passage_id, body, ...): the k best by `scored`, times CONCEPT_BOOST where
    `boost` (over the columns of both) holds."""
    pairs = scored(queries, passages)
    if boost is not None:
        pairs = pairs.withColumn("score", F.col("score") * F.when(boost, fixed.CONCEPT_BOOST).otherwise(1.0))
    ranked = top(pairs, ["query_id"], [F.desc("score"), F.col("passage_id")], k)
    return ranked.select("query_id", "passage_id", "rank", F.round("score", 4).alias("score"), "overlap")


def two_pass(queries: DataFrame, passages: DataFrame, by: str, k: int = fixed.TOP_K) -> DataFrame:
    """(query_id, passage_id, rank, score): the k best, those boosted whose `by` (a column of the passages) is that of the query's best passage.

    A boost is one factor for all passages of a query with one value of `by`, so their order stays: the k best of each value hold the k best of any boost, and the
    pairs are worked out once for both passes.
    """
    held = staged(top(scored(queries, passages), ["query_id", by], [F.desc("score"), F.col("passage_id")], k).select("query_id", "passage_id", by, "score"), "passes")
    order = [F.desc("score"), F.col("passage_id")]
    first = top(held, ["query_id"], order, 1).select("query_id", F.col(by).alias("_best"))
    boosted = held.join(first, "query_id").withColumn("score", F.col("score") * F.when(F.col(by) == F.col("_best"), fixed.CONCEPT_BOOST).otherwise(1.0))
    return top(boosted, ["query_id"], order, k).select("query_id", "passage_id", "rank", F.round("score", 4).alias("score"))


def fixture_overlap(queries: DataFrame, passages: DataFrame, k: int, share: float = fixed.MENTION_SHARE) -> DataFrame:
    """Passages that hold at least `share` of the query's terms, by overlap."""
    q = queries.withColumn("terms", text.lexical_terms(F.col("query"))).withColumn("n", F.size("terms")).select("query_id", "n", F.explode("terms").alias("token"))
    p = passages.select("passage_id", F.explode(text.lexical_terms(F.col("body"))).alias("token"))
    pairs = q.join(p, "token").groupBy("query_id", "passage_id", "n").agg(F.count(F.lit(1)).alias("overlap"))
    return top(pairs.where(F.col("overlap") >= F.ceil(F.col("n") * share)), ["query_id"], [F.desc("overlap"), F.col("passage_id")], k).drop("n")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _matrix(col: pa.ChunkedArray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of d components as rows in double precision, and which rows are such vectors; the others are zeros. A null has d = -1."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(col), d), False)
    flat = pc.list_flatten(col.filter(fits))
    ok = np.array(fits.to_pylist(), bool)
    x = np.zeros((len(ok), max(d, 0)))
    if d < 1:
        return x, ok
    x[ok] = flat.cast(pa.float64()).fill_null(0.0).to_numpy().reshape(-1, d)
    ok[ok] = ~pc.is_null(flat).to_numpy().reshape(-1, d).any(1)
    return x, ok


def _nearest(queries: pa.Table, records: pa.Table, k: int, schema: pa.Schema) -> pa.Table:
    """The k nearest records of each query of a block among the records of a block, in the order of `vector`."""
    ids, qids = records.column("record_id"), queries.column("query_id")
    order = np.empty(len(ids), np.int64)
    order[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    both = pa.chunked_array([*qids.chunks, *ids.cast(qids.type).chunks]).dictionary_encode().combine_chunks().indices.to_numpy()
    q_code, r_code = both[: len(qids)], both[len(qids) :]
    lengths = pc.fill_null(pc.list_value_length(queries.column("q_vec")), -1).to_numpy()
    found = [schema.empty_table()]
    for d in np.unique(lengths):
        mine = np.flatnonzero(lengths == d)
        q, q_ok = _matrix(queries.column("q_vec").take(mine), int(d))
        r, r_ok = _matrix(records.column("r_vec"), int(d))
        for part in np.array_split(np.arange(len(mine)), -(-len(mine) // 64)):
            s = q[part] @ r.T
            s = np.copysign(np.floor(np.abs(s) * 1e9 + 0.5) / 1e9, s) + 0.0
            none = ~(q_ok[part][:, None] & r_ok)
            least = np.where(none, np.inf, np.where(np.isnan(s), -np.inf, -s))
            self_ = q_code[mine[part]][:, None] == r_code
            least[self_] = np.inf
            n = min(k, len(order))
            kth = np.partition(least, n - 1, axis=1)[:, n - 1 : n]
            i, j = np.nonzero((least <= kth) & ~self_)
            by = np.lexsort((order[j], least[i, j], i))
            i, j = i[by], j[by]
            keep = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, j = i[keep], j[keep]
            found.append(pa.table([qids.take(mine[part[i]]), ids.take(j), pa.array(s[i, j], mask=none[i, j], from_pandas=False)], schema=schema))
    return pa.concat_tables(found)


def vector(queries: DataFrame, records: DataFrame, k: int = fixed.CANDIDATES) -> DataFrame:
    """(query_id, record_id, similarity, rank): the nearest records of a set of queries of any size.

    Queries and records meet in blocks: a task compares one block of each and sends k rows a query on. Records are copied once
    for each block of queries, queries once for each block of records. Similarities are rounded to 9 places before ranking; a
    pair without one (a null, or vectors of different lengths) comes last.
    """
    queries, records = queries.where("query_id IS NOT NULL"), records.where("record_id IS NOT NULL")
    blocks = queries.agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("q_blocks")).crossJoin(records.agg(F.greatest(F.lit(RECORD_BLOCKS), F.ceil(F.count(F.lit(1)) / RECORD_BLOCK)).cast("int").alias("r_blocks")))
    dealt = lambda df, own, mine, others, name: df.crossJoin(F.broadcast(blocks)).withColumn(mine, F.pmod(F.xxhash64(own), F.col(others[0])).cast("int")).withColumn(name, F.explode(F.sequence(F.lit(0), F.col(others[1]) - 1)))
    q = dealt(queries, "query_id", "qb", ("q_blocks", "r_blocks"), "rb").select("qb", "rb", "query_id", "q_vec")
    r = dealt(records, "record_id", "rb", ("r_blocks", "q_blocks"), "qb").select("qb", "rb", "record_id", "r_vec")
    kinds = {"query_id": queries.schema["query_id"].dataType, "record_id": records.schema["record_id"].dataType, "similarity": DoubleType()}
    schema = pa.schema([(n, to_arrow_type(t)) for n, t in kinds.items()])
    near = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(lambda a, b: _nearest(a, b, k, schema) if len(a) and len(b) else schema.empty_table(), StructType([StructField(n, t) for n, t in kinds.items()]))
    return top(near, ["query_id"], [F.desc("similarity"), F.col("record_id")], k)


def _best(asked: pa.Table, held: pa.Table, k: int, schema: pa.Schema) -> pa.Table:
    """The k best passages of each query of a block among the passages of a block, by the sum of what their phrases weigh."""
    ids = held.column("passage_id").combine_chunks().dictionary_encode(null_encoding="encode")
    codes, n = ids.indices.to_numpy(), len(ids.dictionary)
    order = np.empty(n, np.int64)
    order[pc.sort_indices(ids.dictionary, null_placement="at_start").to_numpy()] = np.arange(n)
    number, part = held.column("number").to_numpy(), held.column("part").to_numpy()
    by = np.argsort(number, kind="stable")
    codes, number, part = codes[by], number[by], part[by]
    qids = asked.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
    q_code, want, wanted = qids.indices.to_numpy(), asked.column("wants").to_numpy(), asked.column("number").to_numpy()
    found = [schema.empty_table()]
    for q in range(len(qids.dictionary)):
        mine = q_code == q
        lists = [slice(*np.searchsorted(number, [x, x + 1])) for x in wanted[mine]]
        at, of = np.concatenate([codes[x] for x in lists]), np.concatenate([part[x] for x in lists])
        count, total = np.bincount(at, minlength=n), np.bincount(at, of, n)
        hit = np.flatnonzero(count >= max(1, want[mine][0]))
        best = hit[np.lexsort((order[hit], -np.floor(total[hit] * 1e6 + 0.5)))[:k]]
        found.append(pa.table([qids.dictionary.take(pa.array([q] * len(best), pa.int32())), ids.dictionary.take(pa.array(best)), total[best], count[best]], schema=schema))
    return pa.concat_tables(found)


def best_sums(wanted: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """(query_id, passage_id, score, n_phrases, rank): the k passages of each query with the greatest sum, from (query_id, wants, number) and (passage_id, number, part).

    A query has the parts of the numbers it lists, `wants` of them at least. Queries and passages meet in blocks, and a task sends k rows a query on, so pairs of a
    query and a passage are written nowhere. Sums are rounded to 6 places.
    """
    counted = wanted.agg(F.greatest(F.lit(1), F.ceil(F.count_distinct("query_id") / QUERY_BLOCK)).cast("int").alias("q_blocks"))
    blocks = staged(counted.crossJoin(parts.agg(F.greatest(F.lit(RECORD_BLOCKS), F.ceil(F.count(F.lit(1)) / HITS)).cast("int").alias("r_blocks"))), "blocks")
    dealt = lambda df, own, mine, others, name: df.crossJoin(F.broadcast(blocks)).withColumn(mine, F.pmod(F.xxhash64(own), F.col(others[0])).cast("int")).withColumn(name, F.explode(F.sequence(F.lit(0), F.col(others[1]) - 1)))
    q = dealt(wanted, "query_id", "qb", ("q_blocks", "r_blocks"), "rb").drop("q_blocks", "r_blocks")
    r = dealt(parts, "passage_id", "rb", ("r_blocks", "q_blocks"), "qb").drop("q_blocks", "r_blocks")
    kinds = StructType([StructField("query_id", wanted.schema["query_id"].dataType), StructField("passage_id", parts.schema["passage_id"].dataType), StructField("score", DoubleType()), StructField("n_phrases", LongType())])
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in kinds])
    best = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(lambda x, y: _best(x, y, k, schema) if len(x) and len(y) else schema.empty_table(), kinds)
    return top(best.withColumn("score", F.round("score", 6)), ["query_id"], [F.desc("score"), F.col("passage_id")], k).select("query_id", "passage_id", "score", "n_phrases", "rank")


def full_text(queries: DataFrame, passages: DataFrame, k: int = fixed.CANDIDATES, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 over stemmed full-text terms. Each distinct word is stemmed once; only words whose stem a query has are counted by passage."""
    raw = lambda x: F.filter(F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: ~t.isin(list(fixed.FULL_TEXT_STOP)))
    q = staged(queries.select("query_id", F.explode(F.array_distinct(F.transform(raw(F.col("query")), text.stem))).alias("token")), "asked")
    # outer: a plain explode would have its size tested first, which cuts every text up again
    held = passages.select("passage_id", raw(F.col("body")).alias("w")).select("passage_id", F.size("w").alias("dl"), F.explode_outer("w").alias("word")).where("word IS NOT NULL")
    asked = q.select("token").distinct().withColumn("number", F.monotonically_increasing_id())
    known = staged(held.select("word").distinct().withColumn("token", text.stem(F.col("word"))).join(staged(asked, "tokens"), "token").select("word", "token", "number"), "words")
    tf = staged(held.join(known.drop("token"), "word").groupBy("passage_id", "dl", "number").agg(F.count(F.lit(1)).alias("tf")), "tf")
    stats = passages.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(raw(F.col("body")))).alias("avgdl"))
    df = tf.groupBy("number").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = staged(df.crossJoin(F.broadcast(stats)).select("number", idf.alias("weight"), "avgdl"), "weights")
    part = F.col("weight") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    parts = tf.join(weighed, "number").select("passage_id", "number", part.alias("part"))
    wanted = q.join(known.select("token", "number").distinct(), "token").select("query_id", F.lit(1).alias("wants"), "number")
    return best_sums(wanted, parts, k).drop("n_phrases")


def fused(channels: list[DataFrame], weights: tuple[float, ...] = fixed.RRF_WEIGHTS, k: int = fixed.TOP_K, constant: int = fixed.RRF_K) -> DataFrame:
    """Weighted reciprocal rank fusion of (query_id, passage_id, rank)."""
    parts = [c.select("query_id", "passage_id", (F.lit(w) / (constant + F.col("rank"))).alias("part")) for c, w in zip(channels, weights, strict=False)]
    all_ = parts[0]
    for x in parts[1:]:
        all_ = all_.unionByName(x)
    summed = all_.groupBy("query_id", "passage_id").agg(F.round(F.sum("part"), 9).alias("score"), F.count(F.lit(1)).cast("long").alias("n_channels"))
    return top(summed, ["query_id"], [F.desc("score"), F.col("passage_id")], k)


def reserved(ranked: DataFrame, most: int = fixed.PER_FACET) -> DataFrame:
    """(query_id, passage_id, rank, n_facets) from (query_id, facet_no, passage_id, rank); facet_no 0 is the main ranking.

    Each facet's first `most` passages are united with the main ranking; a passage found more than once has its least rank.
    """
    held = ranked.where((F.col("facet_no") == 0) | (F.col("rank") <= most))
    return held.groupBy("query_id", "passage_id").agg(F.min("rank").alias("rank"), F.sum((F.col("facet_no") > 0).cast("long")).alias("n_facets"))


def eligible(passages: DataFrame, flagged: DataFrame, languages: list[str]) -> DataFrame:
    """Passages in scope without an open issue, before any ranking."""
    return passages.where(F.col("lang").isin(languages)).join(flagged, "passage_id", "left_anti")


def widened(queries: DataFrame, passages: DataFrame, tiers: list[Column], k: int, search) -> DataFrame:
    """(query_id, passage_id, score, tier, rank): the first k passages of each query, narrow scopes before wide ones.

    `tiers` are conditions on passages, each wider than the one before; `search(queries, passages, k)` ranks. A tier is searched only for the queries that are still
    short of k, and each round's result is written down; once no query is short, the wider scopes are not read at all.
    """
    found, short = None, queries
    for tier, scope in enumerate(tiers):
        got = search(short, passages.where(scope), k).select("query_id", "passage_id", "score").withColumn("tier", F.lit(tier))
        if found is not None:
            got = got.join(found.select("query_id", "passage_id"), ["query_id", "passage_id"], "left_anti")
        got = staged(got, "tier")
        found = got if found is None else found.unionByName(got)
        full = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        short = short.join(full.select("query_id"), "query_id", "left_anti")
        if tier + 1 < len(tiers) and not short.limit(1).count():
            break
    return top(found, ["query_id"], [F.col("tier"), F.desc("score"), F.col("passage_id")], k)


def soft_file_limit(ranked: DataFrame, k: int, most: int = fixed.PER_FILE, factor: float = fixed.FILE_FACTOR) -> DataFrame:
    """Scores beyond a file's first `most` passages fall by `factor` each; ranked anew."""
    nth = F.row_number().over(Window.partitionBy("query_id", "file").orderBy(F.desc("score"), "passage_id"))
    lowered = ranked.drop("rank").withColumn("nth", nth).withColumn("score", F.round(F.col("score") * F.pow(F.lit(factor), F.greatest(F.lit(0), F.col("nth") - most)), 9))
    return top(lowered, ["query_id"], [F.desc("score"), F.col("passage_id")], k)


def context_budget(ranked: DataFrame, chars: int = fixed.CONTEXT_CHARS) -> DataFrame:
    """Marks, in rank order, the passages that still fit; one that does not fit is skipped and the scan goes on.

    A query's candidates are a bounded list, so the fold is a higher-order function over it.
    """
    items = F.array_sort(F.collect_list(F.struct("rank", "passage_id", "n_chars")))
    state = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<rank:int,passage_id:bigint,n_chars:bigint,kept:boolean>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fits = s["used"] + x["n_chars"] <= chars
        return F.struct((s["used"] + F.when(fits, x["n_chars"]).otherwise(F.lit(0))).cast("long").alias("used"), F.concat(s["out"], F.array(F.struct(x["rank"].cast("int").alias("rank"), x["passage_id"].cast("bigint").alias("passage_id"), x["n_chars"].cast("bigint").alias("n_chars"), fits.alias("kept")))).alias("out"))

    folded = ranked.groupBy("query_id").agg(F.aggregate(items, state, step)["out"].alias("out"))
    return folded.select("query_id", F.explode("out").alias("x")).select("query_id", "x.*")
