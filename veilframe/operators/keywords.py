"""Blocked keywords: case-insensitive substrings, reported in list order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from veilframe.operators.substrings import substring_hits


def matched_keywords(text: Column, keywords: Sequence[str]) -> Column:
    """The keywords of a short list that stand in the text, in list order."""
    keywords = [k for k in keywords if k]
    if not keywords:
        return F.array().cast("array<string>")
    lowered = F.lower(text)
    return F.array_compact(F.array(*[
        F.when(lowered.contains(k.lower()), F.lit(k)) for k in keywords]))


def keyword_hits(df: DataFrame, keywords: DataFrame, key: Sequence[str],
                 text: str = "text") -> DataFrame:
    """(key..., keyword, ord) for a list kept as a table (keyword, ord)."""
    texts = df.select(*key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_body"))
    listed = keywords.withColumn("_lower", F.lower("keyword"))
    hits = substring_hits(texts, listed, key, text="_body", needle="_lower")
    return hits.join(listed, "_lower").select(*key, "keyword", "ord")
