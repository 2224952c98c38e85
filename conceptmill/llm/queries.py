"""The pN_ queries of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import table
from . import encoding, leakage, packing


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every body, or of every piece of a body beyond the capacity, and its place there."""
    return packing.pack(packing.token_counts(table(spark, d, "documents").select("doc_id", "text")))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per container the number of pieces and the tokens in use."""
    return p6_containers(spark, d).groupBy("container").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("size").alias("n_tokens"))


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    """The longest verbatim match of each affected document and item, with its places."""
    return leakage.find_leaks(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_item").select("eval_id", "text"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_matches(spark, d).select("doc_id", "eval_id")


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """The documents that remain once affected ones are removed."""
    return leakage.without_leaks(table(spark, d, "documents").select("doc_id", "lang", "source"), cut(p7_matches(spark, d)))


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    """The affected documents with the original text restored where possible."""
    documents = table(spark, d, "documents").select("doc_id", "text")
    return encoding.restore(documents, encoding.train(documents))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_restored(spark, d).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p6_containers, p6_fill, p7_found, p7_matches, p7_kept, p8_found, p8_restored)}
SQL: dict[str, str] = {}
