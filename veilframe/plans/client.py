"""The client rule pipeline, alone and combined with contextual entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilframe.columns import let, pinned, text_or_empty
from veilframe.functions.labels import entity_label, entity_risk
from veilframe.operators.overlap import longest_first
from veilframe.operators.redact import redact_with_labels
from veilframe.operators.spans import client_entropy_spans, entity_spans, find_spans
from veilframe.rules.client import CLIENT_RULES, ENTROPY_RULE
from veilframe.rules.entities import ENTITY_RULES
from veilframe.rules.model import add_view


def counts_by_type(spans: Column) -> Column:
    """map<type, occurrences> of a row's spans."""
    def build(types):
        return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(types)), lambda t: (
            F.struct(t.alias("key"),
                     F.size(F.filter(types, lambda x: x == t)).alias("value")))))
    return let(F.transform(spans, lambda s: s["type"]), build)


def with_client_spans(df: DataFrame, text: str = "text", rules=CLIENT_RULES,
                      external: Column | None = None, entropy: bool = True,
                      out: str = "spans") -> DataFrame:
    """Add the resolved spans of the client rules, entropy and any external spans.

    Two projections, no shuffle: rule spans are a column of their own because the
    entropy scan looks at them once per token.
    """
    extra = ["_external"] if external is not None else []
    if external is not None:
        df = df.withColumn("_external", external)
    df, view, added = add_view(df, text, (*rules, ENTROPY_RULE) if entropy else rules)
    df = df.withColumn("_ruled", pinned(find_spans(view, rules)))
    parts = [F.col("_ruled")]
    if entropy:
        parts.append(client_entropy_spans(view, F.col("_ruled")))
    if external is not None:
        parts.append(F.filter("_external", lambda s: s["end"] > s["start"]))
    df = df.withColumn(out, pinned(longest_first(F.concat(*parts))))
    return df.drop("_ruled", *added, *extra)


def client_scan(df: DataFrame, text: str = "text", rules=CLIENT_RULES,
                external: Column | None = None) -> DataFrame:
    """Rules, checks, entropy and external spans to redacted text and counts per row."""
    df = with_client_spans(df, text, rules, external)
    body = text_or_empty(text)
    return (df.withColumn("original_length", F.length(body))
            .withColumn("sanitized_text", redact_with_labels(body, F.col("spans")))
            .withColumn("redaction_counts", counts_by_type(F.col("spans")))
            .withColumn("total_redacted", F.size("spans")))


def with_entities(df: DataFrame, text: str = "text", rules=ENTITY_RULES,
                  out: str = "entities") -> DataFrame:
    """Add the resolved contextual entities, in text order."""
    df, view, added = add_view(df, text, rules)
    found = pinned(longest_first(entity_spans(view, rules)))
    return df.withColumn(out, found).drop(*added)


def entities_as_spans(entities: Column, custom_labels: dict[str, str] | None = None) -> Column:
    """Entities in the shape of rule spans: NER_ types, fixed labels, class risk."""
    methods = F.array(F.lit("TRANSFORMERS_NER"), F.lit("INT8_QUANTIZED"))
    return F.transform(entities, lambda e: F.struct(
        e["start"].alias("start"), e["end"].alias("end"),
        F.concat(F.lit("NER_"), e["type"]).alias("type"), e["value"].alias("value"),
        entity_label(e["type"], custom_labels).alias("label"),
        e["confidence"].alias("confidence"), entity_risk(e["type"]).alias("risk"),
        methods.alias("methods"), F.lit(None).cast("double").alias("entropy"),
        F.lit("NER").alias("source")))


def combined_scan(df: DataFrame, text: str = "text", rules=CLIENT_RULES,
                  entity_rules=ENTITY_RULES,
                  custom_labels: dict[str, str] | None = None) -> DataFrame:
    """Contextual entities first, then the client pipeline with them as external spans."""
    df = with_entities(df, text, entity_rules)
    df = df.withColumn("_entity_spans", entities_as_spans(F.col("entities"), custom_labels))
    return client_scan(df, text, rules, F.col("_entity_spans")).drop("_entity_spans")
