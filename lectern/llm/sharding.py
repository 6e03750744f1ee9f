"""Sharding by proportional stratified interleaving.

Rows are ranked in a seeded shuffle of their source; sorted by fractional rank, every stretch of the order has
each source in its share of the whole, so cutting the order into equal counts makes every shard a small copy of
the mixture. Shards' row counts differ by one at most.

Nulls and edge cases: a null text has no bytes (size 8, crc32 0); a null source is a stratum of its own; rows that
repeat are each placed; an empty table gives an empty result; other columns are ignored. Ties of the shuffle are
broken by doc_id, then size, then crc32; rows alike in all of these are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exact_rank

#: Buckets of a rank: as many offsets are kept for each source.
BUCKETS = 4096


def interleaved(docs: DataFrame, shards: int = 24, seed: int = 17) -> DataFrame:
    """(doc_id, size, text_crc32, source, shard, slot) for every row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "source")
    rows = rows.withColumn("_key", F.xxhash64(F.lit(seed), "doc_id", "size", "text_crc32"))
    order = [F.col("_key"), F.col("doc_id"), F.col("size"), F.col("text_crc32")]
    ranked = exact_rank(rows, ["source"], F.shiftrightunsigned(F.col("_key").bitwiseXOR(F.lit(-(2**63)).cast("long")), 52), order, "_rank")
    totals = rows.groupBy(F.col("source").alias("_s")).agg(F.count(F.lit(1)).alias("_of"))
    placed = ranked.join(totals, ranked.source.eqNullSafe(totals._s)).withColumn("_at", (F.col("_rank") + 0.5) / F.col("_of")).drop("_s", "_rank", "_of")
    placed = exact_rank(placed.withColumn("_all", F.lit(0)), ["_all"], F.floor(F.col("_at") * BUCKETS), [F.col("_at"), F.col("source"), *order], "_pos")
    n = rows.agg(F.count(F.lit(1)).alias("_n"))
    shard = F.expr(f"(_pos * {shards}) div _n")
    first = F.expr(f"(shard * _n + {shards - 1}) div {shards}")
    return placed.crossJoin(F.broadcast(n)).withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("_pos") - first).cast("long")).select("doc_id", "size", "text_crc32", "source", "shard", "slot")
