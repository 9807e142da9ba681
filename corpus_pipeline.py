"""From raw documents to packed token ids.

Five stages, each one operator of ``clauseflow.llm`` over all that the stage
before it kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clauseflow.llm import common, decontaminate, jaccard_join, mixing, packing, quality


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.7 and more)."""
    return quality.accepted(docs, common.table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones (5-word shingles, Jaccard 0.8)."""
    return jaccard_join.one_of_each(docs, n=5, num=80, den=100)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items (5-word shingles, containment 0.8)."""
    return decontaminate.clean_rows(docs, common.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed by weight; documents come as often as the mix takes them."""
    return mixing.mixed(docs)


def pack_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token-id rows of the mix."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_good_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("packing", pack_ids),
]

#: A fitted network and a tokenizer are not SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
