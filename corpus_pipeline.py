"""From raw documents to packed training sequences: five stages, each a written table.

    quality      documents that the weakly supervised classifier rejects go
    near_dups    one document of each group of near duplicates stays
    passages     later copies of repeated passages are cut out
    benchmark    documents contaminated with benchmark items go
    packing      what is left is packed into training windows
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from defgrain.llm import decontaminate, line_dedup, near_copies, packing, quality
from defgrain.llm.common import stage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_documents(docs, chars_col="n_chars")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).drop("ids")


STAGES = [
    ("quality", good_quality),
    ("near_dups", one_of_each_group),
    ("passages", without_repeated_passages),
    ("benchmark", without_benchmark),
    ("packing", packed),
]

# Classifier, fingerprints, tokens and retrieval are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what one stage returns is written as Parquet in
    the shared checkpoint folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
