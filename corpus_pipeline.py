"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination, mixing.

Each stage takes what its predecessor kept, written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import decontaminate, language, mixing, simhash, suffix_tree
from sparkloom.llm.common import materialise, reach_workers, table
from sparkloom.session import discard, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, whose language is `und`, go."""
    return language.keep_known(docs, language.fit(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose sets of five-word shingles have a likeness of 0.8 or more, the document with the least doc_id stays."""
    return simhash.first_of_each(docs, simhash.similar_documents(docs))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated 50-word windows go; a document without words left goes whole."""
    return suffix_tree.cut_documents(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says, with rate and copy."""
    return mixing.mixed_documents(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]
#: The stages train models and trace components, which SQL can't express; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. What a stage wrote on the way is removed when its result is written; that of the last is left to `session.discard`."""
    reach_workers(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = written()
        docs = materialise(stage(spark, docs, sf_dir), name)
        discard(spark, before, keep=name)
    return STAGES[-1][1](spark, docs, sf_dir)
