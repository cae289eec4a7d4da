"""The corpus pipeline: quality rules, quality classifier, near-duplicate removal, mixing, packing.

Each stage takes all documents that the one before kept, and all but the last return rows of ``documents``. No SQL is given:
the classifier is a trained model, which SQL can't express; the tests hold the stages against brute-force versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.llm import compression_classifier, jaccard_join, mixing, packing, quality_rules
from spectraloom.llm.common import table
from spectraloom.sources.shared import written


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model is fitted on labelled rows of the whole table: the rules have taken most of the bad ones from ``docs``."""
    labels = table(spark, sf_dir, "labels").where(compression_classifier.fold(F.col("doc_id")) != 1)
    return compression_classifier.keep_accepted(docs, compression_classifier.fit(table(spark, sf_dir, "documents"), labels))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample_mixture(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, keep_ids=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", rules_stage),
    ("quality classifier", classifier_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("mixing sources to target weights", mixing_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None
#: Bytes of a row group between stages: of whole texts, Spark's usual 128 MB in each of a small heap's tasks are too much.
BLOCK = 8 << 20


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), BLOCK)
    return STAGES[-1][1](spark, docs, sf_dir)
