"""Queries of the text problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm import leaks, pairs, prose, secrets, spam, syntax, tokenize
from graphloom.sources.tables import table


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.encode_texts(table(spark, d, "documents"))


def p7_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Texts that aren't the same after encoding and decoding: none."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    back = tokenize.decode_ids(tokenize.encode_texts(docs)).withColumnRenamed("text", "back")
    return docs.join(back, "doc_id").where("coalesce(text, '') <> back").select("doc_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.broken_files(table(spark, d, "source_files"))


def p3_errors(spark: SparkSession, d: str) -> DataFrame:
    return syntax.error_rows(table(spark, d, "source_files"))


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.acceptance(table(spark, d, "source_files"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.found_pairs(table(spark, d, "source_files"))


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.function_pairs(table(spark, d, "source_files")).distinct()


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leak_pairs(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Documents that each leaked item stands in, and its longest passage."""
    found = leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("most_words"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(spark, d, "documents"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_scores(table(spark, d, "documents"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return prose.found_prose(table(spark, d, "source_files"), table(spark, d, "documents"))


def p4_shares(spark: SparkSession, d: str) -> DataFrame:
    return prose.prose_shares(table(spark, d, "source_files"), table(spark, d, "documents"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.credentials(table(spark, d, "source_files"), table(spark, d, "documents"))


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Files with credentials, redacted."""
    return secrets.redacted(table(spark, d, "source_files"), table(spark, d, "documents")).where("credentials > 0").distinct()


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted, "p4_found": p4_found, "p4_shares": p4_shares, "p8_found": p8_found, "p8_items": p8_items, "p9_found": p9_found, "p9_scores": p9_scores, "p6_found": p6_found, "p6_pairs": p6_pairs, "p3_found": p3_found, "p3_errors": p3_errors, "p3_rates": p3_rates, "p7_ids": p7_ids, "p7_roundtrip": p7_roundtrip}
ORACLES = {"p7_roundtrip": "SELECT doc_id FROM documents WHERE false"}
