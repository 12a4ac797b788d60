"""Corpus pipeline: documents -> rules -> near-duplicates -> repeated passages -> mix -> packed sequences.

Every stage takes any rows: null texts are empty (and the rules reject them), null ids count as the largest, null sources
are a source, repeated rows are rows, further columns travel along, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobgrain.llm import mixing, packing, quality, queries, simhash, suffixes
from jobgrain.llm.common import discard, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v3 of the rules rejects go, texts without words among them; short ones stay."""
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id, then the smallest hash of its text."""
    return simhash.drop_near_duplicates(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that repeat stay in one place, the smallest id's first one, and are cut elsewhere; a
    document cut to nothing goes."""
    return suffixes.drop_repeats(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; of equal rows the first take what does not divide evenly."""
    return mixing.repeat_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their places in sequences. Workers still hold what earlier stages needed, so they remember
    fewer words."""
    return packing.pack_documents(docs, queries.word_tokenizer(), end_id=0, remembered=400_000).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mix_to_weights", mix_to_weights),
    ("best_fit_packing", best_fit_packing),
]

#: SQL has neither the hashes nor the tokenizer; the stages are tested against plain restatements.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each written and read again, and deleted once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    return docs
