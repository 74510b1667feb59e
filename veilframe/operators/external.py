"""Spans that come in from outside as tables: model predictions and entities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from veilframe.functions.labels import entity_label, entity_risk, type_of_model_label
from veilframe.operators.spans import SPANS, no_spans

# Thresholds of the two callers, and the labels that the service asks for.
SERVICE_THRESHOLD = 0.22
GATEWAY_THRESHOLD = 0.35
MODEL_LABELS = (
    "PERSON_NAME", "DOCTOR_NAME", "MEDICAL_FACILITY", "MEDICAL_RECORD_NUMBER",
    "STREET_ADDRESS", "ORGANIZATION", "LOCATION", "API_KEY", "SECRET_TOKEN",
    "DATABASE_CREDENTIAL", "SOCIAL_SECURITY_NUMBER", "CREDIT_CARD_NUMBER",
)


def _collect(df: DataFrame, rows: DataFrame, key, out: str) -> DataFrame:
    spans = rows.groupBy(*key).agg(
        F.array_sort(F.collect_list("_span")).cast(SPANS).alias(out))
    return df.join(spans, list(key), "left").withColumn(out, F.coalesce(out, no_spans()))


def with_model_spans(df: DataFrame, predictions: DataFrame, key: Sequence[str],
                     text: str = "text", threshold: float = GATEWAY_THRESHOLD,
                     labels: Sequence[str] | None = None, out: str = "external") -> DataFrame:
    """Attach model predictions (key..., label, text, start, end, score) as spans.

    Kept: score at or above the threshold, offsets inside the text and, where ``labels``
    are named, one of these. Without predictions a text simply has none.
    """
    p = predictions.select(
        *key, F.upper("label").alias("_label"), F.col("text").alias("_value"),
        F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"),
        F.round(F.col("score"), 3).alias("_score"), F.col("score").alias("_raw"))
    p = p.filter((F.col("_raw") >= threshold) & (F.col("start") >= 0)
                 & (F.col("end") > F.col("start")))
    if labels is not None:
        p = p.filter(F.col("_label").isin(*[label.upper() for label in labels]))
    span = F.struct(
        F.col("start").alias("start"), F.col("end").alias("end"),
        type_of_model_label(F.col("_label")).alias("type"), F.col("_value").alias("value"),
        F.lit("").alias("label"), (F.col("_score") * 100).alias("confidence"),
        F.lit("HIGH").alias("risk"), F.array(F.lit("MODEL")).alias("methods"),
        F.lit(None).cast("double").alias("entropy"), F.lit("NEMOTRON").alias("source"))
    joined = _collect(df, p.select(*key, span.alias("_span")), key, out)
    body = F.coalesce(F.col(text), F.lit(""))
    inside = F.filter(out, lambda s: s["end"] <= F.length(body))
    named = F.transform(inside, lambda s: s.withField("value", F.coalesce(
        F.when(s["value"] != "", s["value"]),
        F.substring(body, s["start"] + 1, s["end"] - s["start"]))))
    return joined.withColumn(out, named)


def with_entity_table(df: DataFrame, entities: DataFrame, key: Sequence[str],
                      text: str = "text", out: str = "external") -> DataFrame:
    """Attach entities (key..., type, text, start, end, confidence) with fixed labels."""
    e = entities.filter(F.col("end") > F.col("start"))
    type_ = F.col("type")
    span = F.struct(
        F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"),
        F.concat(F.lit("NER_"), F.coalesce(type_, F.lit("ENTITY"))).alias("type"),
        F.col("text").alias("value"),
        F.coalesce(entity_label(type_), F.lit("[ENTITY_REDACTED]")).alias("label"),
        F.coalesce(F.col("confidence"), F.lit(99.0)).alias("confidence"),
        entity_risk(type_).alias("risk"),
        F.array(F.lit("TRANSFORMERS_NER"), F.lit("INT8_QUANTIZED")).alias("methods"),
        F.lit(None).cast("double").alias("entropy"), F.lit("NER").alias("source"))
    joined = _collect(df, e.select(*key, span.alias("_span")), key, out)
    body = F.coalesce(F.col(text), F.lit(""))
    return joined.withColumn(out, F.transform(out, lambda s: s.withField(
        "value", F.coalesce(F.when(s["value"] != "", s["value"]), F.substring(
            body, s["start"] + 1, s["end"] - s["start"])))))
