"""Telemetry receipts: size gate, defaults, and receipts made from scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veilframe.functions.language import script_language
from veilframe.functions.quality import (
    RECEIPT_LIMIT_BYTES, payload_bytes, receipt_risk_level, receipt_risk_score,
)

RECEIPT_FIELDS = ("txId", "ts", "source", "tokenCount", "redactionTypes", "processingTimeMs",
                  "language", "riskLevel", "riskScore")


def measure(receipts: DataFrame) -> DataFrame:
    """Add the payload size of each receipt."""
    fields = [c for c in receipts.columns if c != "payload_bytes"]
    return receipts.withColumn("payload_bytes", payload_bytes(*fields))


def accepted(receipts: DataFrame, limit: int = RECEIPT_LIMIT_BYTES) -> DataFrame:
    return measure(receipts).filter(F.col("payload_bytes") <= limit)


def rejected(receipts: DataFrame, limit: int = RECEIPT_LIMIT_BYTES) -> DataFrame:
    return measure(receipts).filter(F.col("payload_bytes") > limit)


def normalise(receipts: DataFrame) -> DataFrame:
    """Defaults for missing fields; a receipt without types is a CLEAN_SCAN."""
    types = F.col("redactionTypes")
    source = F.when(F.coalesce(F.col("source"), F.lit("")) == "", "EXTENSION").otherwise(
        F.col("source"))
    extra = ["payload_bytes"] if "payload_bytes" in receipts.columns else []
    return receipts.select(
        F.coalesce("txId", F.concat(F.lit("tx_"), F.replace(F.uuid(), F.lit("-"), F.lit(""))))
        .alias("id"),
        "ts", source.alias("source"),
        F.when(F.coalesce(F.size(types), F.lit(0)) > 0, types)
        .otherwise(F.array(F.lit("CLEAN_SCAN"))).alias("entities_found"),
        F.coalesce("tokenCount", F.lit(0)).alias("tokenCount"),
        F.coalesce("language", F.lit("en")).alias("language"),
        F.coalesce("riskLevel", F.lit("MEDIUM")).alias("riskLevel"),
        F.coalesce("riskScore", F.lit(50)).alias("riskScore"),
        *extra, F.lit("CLIENT_SANITIZED_CONFIRMED").alias("status"))


def receipts_of(scanned: DataFrame, key: str, text: str = "text",
                source: str = "WEB PLAYGROUND", spans: str = "spans") -> DataFrame:
    """A receipt without any text for each scanned row."""
    return scanned.select(
        F.concat(F.lit("tx_"), F.col(key).cast("string")).alias("txId"),
        F.lit(source).alias("source"), F.size(spans).alias("tokenCount"),
        F.transform(spans, lambda s: s["type"]).alias("redactionTypes"),
        script_language(F.coalesce(F.col(text), F.lit(""))).alias("language"),
        receipt_risk_level(F.transform(spans, lambda s: s["risk"])).alias("riskLevel"),
        receipt_risk_score(F.size(spans)).alias("riskScore"))
