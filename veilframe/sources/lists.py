"""Loading reference lists: knowledge base and keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def load_knowledge(entries: DataFrame) -> DataFrame:
    """(token, label) from (token, label, ord): trimmed, non-empty, last label wins."""
    token = F.trim("token")
    label = F.coalesce(F.when(F.col("label") != "", F.col("label")),
                       F.lit("KNOWLEDGE_BASE_MATCH"))
    return (entries.select(token.alias("token"), label.alias("label"), "ord")
            .filter(F.col("token") != "")
            .groupBy("token").agg(F.max_by("label", "ord").alias("label")))


def load_keywords(entries: DataFrame) -> DataFrame:
    """Distinct keywords with the place of their first appearance."""
    return entries.groupBy("keyword").agg(F.min("ord").alias("ord"))
