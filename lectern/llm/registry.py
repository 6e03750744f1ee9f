"""Queries of the training-data operators: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import asof, embeddings, licenses, lines, manifest, minhash, mixing, packing, pii, quality, sharding, suffixes, toxicity


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_docs(spark, sf_dir), k=2, percent=80)


def op2_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.deduplicated(_docs(spark, sf_dir), whole_runs=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op4_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.9)


def op5_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(_docs(spark, sf_dir))


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_docs(spark, sf_dir))


def op7_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_docs(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op8_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return toxicity.scored(docs, toxicity.trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.interleaved(_docs(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.removed(_docs(spark, sf_dir))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.proven(_docs(spark, sf_dir))


def op12_tolerant_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.matched(spark.read.parquet(f"{sf_dir}/clicks.parquet"), spark.read.parquet(f"{sf_dir}/sales.parquet"))


def op13_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_docs(spark, sf_dir))


_ALL = [
    op1_hyperminhash, op2_entropy_mix, op3_line_dedup, op4_cross_polytope, op5_pii_skip_chain, op6_harmonic_packing, op7_quality_mcd,
    op8_toxicity_nnpu, op9_stratified_shards, op10_suffix_dedup, op11_merkle_manifest, op12_tolerant_asof, op13_license_diagonals,
]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}

ORACLES: dict[str, str] = {"op11_merkle_manifest": manifest.SQL, "op12_tolerant_asof": asof.SQL, "op13_license_diagonals": licenses.SQL}
