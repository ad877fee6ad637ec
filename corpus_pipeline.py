"""A corpus for training: toxicity, line dedup, near-dedup, suffix-array dedup and packing, in this order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtally.llm import line_templates, near_dedup, packing, substrings, toxicity
from voxtally.llm.common import settle


def _recounted(docs: DataFrame) -> DataFrame:
    """`docs` whose n_chars tells the length of the text as it is now."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier does not call toxic, over their whole texts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    classifier = toxicity.fit(docs, labels)
    return toxicity.score(docs, classifier, score_col="__score").where("__score < 0.5").drop("__score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of templates that recur across documents."""
    return _recounted(line_templates.drop_templates(docs))


def near_dedup_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, of similarity 0.8 or more in five-word shingles."""
    return near_dedup.deduplicate(docs, percent=80, n_bands=64, rows=7)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 50-byte strings that a document of smaller id holds."""
    return _recounted(substrings.remove_repeats(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of all documents' pieces in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup_filter),
    ("suffix_array_dedup", suffix_array_dedup),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each on a stored table of what the one before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
