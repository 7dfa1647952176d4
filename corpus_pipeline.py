"""A corpus from raw documents to a mix: five stages, each calling one operator of lodestone.llm.

Every stage works on all rows that the one before kept. Documents that the toxicity model rejects go; one row of each group of
equal texts stays (the largest id), then one of each group of near duplicates (the least id); documents that
hold a benchmark item go; the rest are mixed to the sources' target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontamination, exact_dedup, mixing, ngram_join, toxicity
from lodestone.llm._store import new_path, scratch


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.kept(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.kept(docs)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.kept(docs)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [("toxicity", not_toxic), ("exact_dedup", distinct_texts), ("ngram_join", one_of_each_class), ("decontamination", not_in_benchmark), ("mixing", mixed)]

#: A trained model decides the first stage, so no SQL gives the rows; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
