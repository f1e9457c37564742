"""Documents to tokens: rules, near-duplicates, secrets, mix, encoding. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factorloom.llm import bpe, mixing, quality_rules, secrets, simhash
from factorloom.llm.common import fresh, table
from factorloom.llm.queries import word_vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that fail a base rule or that the trees reject."""
    return quality_rules.keep_good(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of smallest id."""
    return simhash.keep_one(docs).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, confirmed secrets masked."""
    return secrets.redact(docs, secrets.train(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.apply_mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document taken: its number of tokens and the digests of its ids and its decoded text."""
    return bpe.encode_digests(docs, word_vocabulary())


STAGES = [
    ("quality_rules", apply_quality_rules),
    ("simhash", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mix", mix_sources),
    ("bpe", encode_tokens),
]

#: The trees and the forest are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        to = fresh(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(to)
        docs = spark.read.parquet(to)
    return docs
