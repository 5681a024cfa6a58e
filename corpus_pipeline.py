"""The corpus pipeline: stages over ``documents``, each written as Parquet and read by the next."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tuturan.llm import mixing, packing, quality_cnn, rule_trees, simhash
from tuturan.llm.common import ship, table, write_once
from tuturan.llm.queries import END_OF_PACKED, SEQUENCE, tokenizer_path


def _stage(fn):
    @wraps(fn)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, docs, sf_dir)

    return run


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All documents and labels: a model also learns from what an earlier stage rejects."""
    return table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the boosted trees keep."""
    return rule_trees.accepted(docs, rule_trees.fit(*_labelled(spark, sf_dir)))


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the convolutional network accepts."""
    return quality_cnn.accepted(docs, quality_cnn.fit(*_labelled(spark, sf_dir)))


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id."""
    return simhash.one_of_each(docs)


@_stage
def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order in which the sources reach their target weights."""
    return mixing.mixed(docs)


@_stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the documents, with its sequence and offset."""
    return packing.digest(*packing.pack(docs, tokenizer_path(), END_OF_PACKED, SEQUENCE, keep_ids=False))


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("source_mixture", source_mixture),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None  # trained models and tokens have no SQL; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = write_once(docs, name)
    return docs
