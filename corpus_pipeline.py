"""The corpus pipeline: quality rules, near-copy removal, benchmark decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and all rows its predecessor kept. All but the last return the columns of
documents; the mix repeats a document's row as often as it takes it; the last returns the digest of the token files,
one row a document row in ascending doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesselon.llm import decontaminate, mixing, ngram_join, quality, queries


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return queries.write_and_read(spark, docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("token-ID output", token_output),
]

#: Stages 1 and 5 can't be written in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
