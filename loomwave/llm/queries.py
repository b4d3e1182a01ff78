"""Queries of the text problems."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomwave.llm import encoding, leakage, truncation
from loomwave.session import table

#: Path of the vocabulary file; the environment may name another.
VOCABULARY = os.environ.get("LOOMWAVE_VOCABULARY") or public_tokenizers.path("byte_bpe_50k.json")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = encoding.Vocabulary.load(VOCABULARY, public_tokenizers.PATTERN)
    return encoding.encode_corpus(table(spark, d, "documents").select("doc_id", "text"), vocabulary).drop("text")


def p6_sources(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = encoding.Vocabulary.load(VOCABULARY, public_tokenizers.PATTERN)
    return encoding.token_report(encoding.encode_corpus(table(spark, d, "documents").select("source", "text"), vocabulary).drop("text"), "source")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).where("quoted").select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.item_report(_leaks(spark, d), table(spark, d, "benchmark"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.find_truncated(table(spark, d, "documents")).select("doc_id")


def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return truncation.truncation_report(documents, truncation.find_truncated(documents))


QUERIES = {f.__name__: f for f in (p6_ids, p6_sources, p7_found, p7_items, p8_found, p8_sources)}
ORACLE: dict[str, str] = {}
