"""Knowledge-base lookup by equi-join, for lists kept as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from veilframe.columns import let, pinned
from veilframe.operators.spans import SPANS, knowledge_token_places, knowledge_tokens, no_spans
from veilframe.operators.substrings import may_be_among


def known_span() -> list[Column]:
    """Type, and what follows the value, of a span of a listed token."""
    return [
        F.lit("KNOWLEDGE_BASE_MATCH").alias("type"), F.lit("[ASSET_REDACTED]").alias("label"),
        F.lit(100.0).alias("confidence"), F.lit("HIGH").alias("risk"),
        F.array(F.lit("KNOWLEDGE_BASE")).alias("methods"), F.lit(None).cast("double").alias("entropy"),
        F.lit("KNOWLEDGE_BASE").alias("source")]


def listed_tokens(df: DataFrame, knowledge: DataFrame, key: Sequence[str],
                  text: str = "text") -> DataFrame:
    """(key..., known) of the texts with listed tokens: these tokens and their labels, each once.

    A text leaves one row for each distinct token, without places, that a bit table of the list lets through, and
    these meet the list in an equi-join: tokens that are not listed are never exchanged, however long the list is.
    The list is unique per token, and read more than once: give a written table where it is costly.
    """
    tokens = F.array_distinct(knowledge_tokens(F.coalesce(F.col(text), F.lit(""))))
    # explode_outer, so that no size filter is made that would cut the tokens out a second time.
    rows = df.select(*key, F.explode_outer(tokens).alias("token")).filter(F.col("token").isNotNull())
    rows = rows.filter(may_be_among(F.xxhash64("token"), knowledge.select(F.xxhash64("token").alias("_gram"))))
    return (rows.join(knowledge.select("token", "label"), "token").groupBy(*key)
            .agg(F.map_from_entries(F.collect_list(F.struct("token", "label"))).alias("known")))


def known_places(text: Column, known: Column) -> Column:
    """(start, end, value, label) of every token of the text that is in its map of known tokens."""
    def labelled(found):
        return F.filter(F.transform(found, lambda p: F.struct(
            p["start"].alias("start"), p["end"].alias("end"), p["value"].alias("value"),
            known[p["value"]].alias("label"))), lambda p: p["label"].isNotNull())
    return F.when(known.isNotNull(), let(knowledge_token_places(text), labelled))


def knowledge_matches(df: DataFrame, knowledge: DataFrame, key: Sequence[str],
                      text: str = "text") -> DataFrame:
    """(key..., start, end, value, label) of every token that is in the list.

    A text is read once and leaves its places, which meet the list in an equi-join on the token; texts are
    not joined with anything. The list is unique per token, so rows of frequent tokens are split without copies.
    ``key`` names a text.
    """
    places = knowledge_token_places(F.coalesce(F.col(text), F.lit("")))
    rows = df.select(*key, F.explode_outer(pinned(places)).alias("_t")).filter(F.col("_t").isNotNull()).select(*key, "_t.*")
    return rows.join(knowledge.select(F.col("token").alias("value"), "label"), "value").select(
        *key, "start", "end", "value", "label")


def with_knowledge(df: DataFrame, knowledge: DataFrame, key: Sequence[str], text: str = "text",
                   out: str = "external") -> DataFrame:
    """Add the spans of the listed tokens of each text, for the span pipelines."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = known_places(body, F.col("known"))
    spans = F.transform(found, lambda p: F.struct(
        p["start"].alias("start"), p["end"].alias("end"), known_span()[0], p["value"].alias("value"), *known_span()[1:]))
    return (df.join(listed_tokens(df, knowledge, key, text), list(key), "left")
            .withColumn(out, F.coalesce(spans.cast(SPANS), no_spans())).drop("known"))


def matches_as_spans(matches: DataFrame, key: Sequence[str], out: str = "external"):
    """One row per text with its matches as a span array, for the span pipelines."""
    span = F.struct("start", "end", known_span()[0], "value", *known_span()[1:])
    return matches.groupBy(*key).agg(
        F.array_sort(F.collect_list(span)).cast(SPANS).alias(out))
