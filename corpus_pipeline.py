"""A corpus from raw documents to packed sequences, stage by stage.

quality rules -> line dedup -> near-dedup -> mix of sources -> packing. Every stage works on all rows that the one before
it kept; what it rejects, removes or repeats is so for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import lines, minhash, mixing, packing, quality
from lectern.llm.common import staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base limits or lie far outside their language and source go."""
    return quality.filtered(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are cut out of the texts; a document of which no word is left goes."""
    out = lines.cut(docs, whole_runs=True)
    out = out.where((F.col("n_removed") == 0) | (mixing.word_count(F.col("text")) > 0))
    changed = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return out.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more."""
    return minhash.deduplicated(docs, k=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken 0 to 3 times, so that the sources' words meet their targets."""
    return mixing.mixed(docs)


def harmonic_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    return packing.packed(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("minhash near-dedup", near_dedup), ("source mix", source_mix), ("packing", harmonic_packing)]

#: The stages use Jaccard graphs and a tokenizer, which SQL cannot express; tests/llm compares each stage and run() with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
