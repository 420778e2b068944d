"""Queries of the text problems, each with SQL where SQL can give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gristmill.llm import bpe, credentials, mixing, stuffing
from gristmill.session import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines on which a credential's value begins."""
    return credentials.find_credentials(table(spark, d, "source_lines")).select("root", "file", "line").distinct()


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    """All lines with credentials redacted."""
    return credentials.redact_credentials(table(spark, d, "source_lines"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_documents(table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix of all sources."""
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of each source."""
    targets = table(spark, d, "mix_targets")
    return mixing.mix_shares(mixing.mix_sources(table(spark, d, "documents"), targets), targets)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Keyword-stuffed and link-list pages."""
    return stuffing.find_stuffed(table(spark, d, "documents"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Shares and features of every document."""
    return stuffing.score_stuffing(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p6_found, p6_redacted, p7_ids, p8_mix, p8_shares, p9_found, p9_scores)}
ORACLE: dict[str, str] = {}
