"""A corpus in five stages: toxic documents go, then copies, near copies and benchmark leaks; the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the docs of the next
one. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trolley.llm import decontaminate, exact_dedup, ngram_join, packing, toxicity
from trolley.llm.common import released, stored, table, temporary


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic),
    ("exact_dedup", exact_copies),
    ("ngram_join", near_copies),
    ("decontaminate", benchmark_leaks),
    ("packing", packed),
]

#: SQL can't express the classifier, the tokenizer or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. Once a stage is written, what it stored meanwhile and its input are deleted; only the last one's tables stay, as its result is read later."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with temporary():
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
        released(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
