"""One query an operator, with production parameters over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tesselon.llm import chat, decontaminate, licenses, mixing, ngram_join, quality, token_codec, token_counts, toxicity, url_filter
from tesselon.llm.common import Scratch, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


@query("op3_chat_format", chat.ORACLE)
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    messages = chat.with_probe(table(spark, sf_dir, "conversations"), spark)
    return chat.digests(chat.format_conversations(messages.withColumn("content", chat.text_part(F.col("text")))))


@query("op6_url_filter", url_filter.ORACLE)
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.entry_table(spark, url_filter.RULES)).drop("n_candidates")


@query("op9_mix", mixing.ORACLE)
def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))

@query("op8_quality", None)
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


@query("op1_ngram_join", ngram_join.ORACLE)
def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def write_and_read(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Writes docs as a token dataset in the shared folder and reads its digest back."""
    path = Scratch(spark, "token-dataset").root
    token_codec.write_dataset(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return token_codec.read_digest(spark, path)


@query("op5_token_output")
def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_and_read(spark, table(spark, sf_dir, "documents"))


@query("op4_decontaminate")
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_licenses")
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))
