"""From documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
what a stage returns as Parquet to the folder in spark.checkpoint.dir and gives the
next stage what it reads there. All stages but the last return the columns of
documents; a row without doc_id goes through all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohortline.llm import common, jaccard, mixing, packing, quality, queries, suffix


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by all labels of quality, does not reject."""
    return quality.kept_by_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest id."""
    return common.fewer(jaccard.without_duplicates(docs))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that one with a smaller id has as well."""
    return common.fewer(suffix.without_repeats(docs))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source takes them."""
    return common.fewer(mixing.mixed_documents(docs))


def cost_balanced_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack(docs, queries.vocabulary())


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", jaccard_join),
    ("suffix-array dedup", suffix_dedup),
    ("mixing sources to target weights", source_mixing),
    ("packing", cost_balanced_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences from the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), few=False)
    return docs


#: The classifier's scores and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
