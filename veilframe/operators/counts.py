"""Counts of spans per type, per document and over a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from veilframe.operators.tokens import span_rows


def redactions_per_type(df: DataFrame, key: Sequence[str] = (), spans: str = "spans") -> DataFrame:
    """Occurrences per type, over the table or per key; counted before any shuffle."""
    rows = span_rows(df, list(key), spans)
    return rows.groupBy(*key, "type").agg(F.count("*").alias("n"))


def types_per_scope(df: DataFrame, scope: Sequence[str], types: str = "pii_types") -> DataFrame:
    """Distinct types per scope; the set is as small as the list of types."""
    rows = df.select(*scope, F.explode_outer(types).alias("_type"))
    return rows.groupBy(*scope).agg(F.array_sort(F.collect_set("_type")).alias("pii_types"))
