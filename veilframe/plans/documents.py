"""The gate for text read from images: empty, blocked, threat, redacted or clean."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veilframe.columns import text_or_empty, trim_blank
from veilframe.operators.keywords import matched_keywords
from veilframe.operators.spans import has_injection
from veilframe.operators.threat import threat
from veilframe.plans.gateway import gateway_scan
from veilframe.plans.policy import Policy


def image_text_gate(df: DataFrame, policy: Policy = Policy(), text: str = "text") -> DataFrame:
    """Action, risk, audit types and sanitised text of each image's text. No shuffle."""
    df = df.withColumn("_body", trim_blank(text_or_empty(text)))
    df = gateway_scan(df, "_body", policy.profile)
    df = df.withColumn("keywords", matched_keywords(F.col("_body"), policy.blocked_keywords))
    df = df.withColumn("_threat", threat(has_injection(F.col("_body")), F.col("pii_types")))
    empty, blocked = F.col("_body") == "", F.size("keywords") > 0
    stopped = F.col("_threat.action") != "FORWARDED"
    found = F.col("n_values") > 0
    none = F.array().cast("array<string>")
    action = (F.when(empty, "NO_TEXT_DETECTED").when(blocked, "BLOCKED")
              .when(stopped, F.col("_threat.action"))
              .when(found, "REDACTED_AND_STRUCTURED").otherwise("CLEAN_DOCUMENT"))
    audit_types = (F.when(empty, none)
                   .when(blocked, F.array(F.lit("CONFIDENTIAL_BLACK_KEYWORD"),
                                          F.lit("OCR_DOCUMENT")))
                   .when(stopped, F.concat("pii_types", F.array(F.concat(
                       F.lit("OCR_THREAT_"), F.col("_threat.risk_level")))))
                   .otherwise(F.concat("pii_types", F.array(F.lit("OCR_DOCUMENT")))))
    audit_prompt = (F.when(blocked, F.concat(
                        F.lit("[OCR BLOCKED BY CONFIDENTIAL BLACKLIST: "),
                        F.array_join("keywords", ", "), F.lit("]")))
                    .when(stopped, F.concat(
                        F.lit("[OCR BLOCKED BY THREAT ENGINE: "),
                        F.array_join("_threat.reasons", ", "), F.lit("]")))
                    .otherwise(F.col("sanitized_text")))
    counted = ~empty & ~blocked
    return (df
            .withColumn("action", action)
            .withColumn("risk_level", F.when(counted, F.col("_threat.risk_level")))
            .withColumn("risk_score", F.when(empty, F.lit(0.0))
                        .when(counted, F.col("_threat.score")))
            .withColumn("pii_types_detected", audit_types)
            .withColumn("tokens_redacted_count", F.when(counted, F.col("n_values")).otherwise(0))
            .withColumn("sanitized_prompt", audit_prompt)
            .drop("_body", "_threat", "spans", "matches", "token_map", "language"))
