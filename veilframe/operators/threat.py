"""Threat score, level, action and reasons of a prompt."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
SECRET_REASON = "Exposed live infrastructure secret or API key"
INJECTION_REASON = "Potential LLM prompt injection or jailbreak attempt detected"
PERSONAL_REASON = "Standard PII sanitized locally"
CLEAN_REASON = "Clean prompt"
BLOCKING_TYPES = ("SECRET_KEY", "API_KEY", "DB_CONNECTION_STRING")


def threat(injection: Column, types: Column) -> Column:
    """struct<score, risk_level, action, reasons> from the injection flag and the types."""
    exposed = F.arrays_overlap(types, F.lit(list(BLOCKING_TYPES)))
    raw = F.when(exposed, 0.5).otherwise(0.0) + F.when(injection, 0.6).otherwise(0.0)
    score = F.round(F.least(F.lit(1.0), raw), 2)
    serious = F.array_compact(F.array(F.when(exposed, F.lit(SECRET_REASON)),
                                      F.when(injection, F.lit(INJECTION_REASON))))
    mild = F.array(F.when(F.size(types) > 0, PERSONAL_REASON).otherwise(CLEAN_REASON))
    return F.struct(
        score.alias("score"),
        F.when(score >= 0.8, "CRITICAL").when(score >= 0.4, "HIGH").otherwise("LOW")
        .alias("risk_level"),
        F.when(score >= 0.8, "QUARANTINED").when(score >= 0.4, "BLOCKED")
        .otherwise("FORWARDED").alias("action"),
        F.when(score >= 0.4, serious).otherwise(mild).alias("reasons"))
