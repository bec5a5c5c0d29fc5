"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and is written as Parquet before the next one
reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from drivetrove.llm.common import materialize, table
from drivetrove.llm.contamination import without_contaminated
from drivetrove.llm.mixing import mix
from drivetrove.llm.neardup import one_of_each
from drivetrove.llm.pii import without_personal_data
from drivetrove.llm.quality import only_good


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the quality trees keep."""
    return only_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets."""
    return without_personal_data(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("mixing", mixing),
]

#: Trained trees, minhashing and the field have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
