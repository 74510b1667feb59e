"""Decisions over whole conversations: blacklist, redaction, threat, audit record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veilframe.columns import text_or_empty
from veilframe.functions.labels import token_prefix
from veilframe.operators.keywords import matched_keywords
from veilframe.operators.redact import redact_with_tokens, token_map
from veilframe.operators.spans import has_injection
from veilframe.operators.threat import threat
from veilframe.operators.tokens import (
    apply_placeholders, assign_placeholders, gateway_placeholder, span_rows,
)
from veilframe.plans.gateway import with_gateway_spans
from veilframe.plans.policy import Policy

PRE_SANITIZED = "[Pre-Sanitized Client Prompt]"


def scan_messages(messages: DataFrame, policy: Policy = Policy(), text: str = "text",
                  role: str = "role", external: Column | None = None) -> DataFrame:
    """Per message: spans, types, counts, keyword and injection findings. No shuffle.

    Keywords and injection phrases are looked for in user messages only. Neither spans a
    line break, so looking at each message equals looking at the joined prompt.
    """
    if any("\n" in k for k in policy.blocked_keywords):
        raise ValueError("a blocked keyword may not contain a line break")
    body, user = text_or_empty(text), F.col(role) == "user"
    df = with_gateway_spans(messages, text, policy.profile, external=external)
    none = F.array().cast("array<string>")
    return (df
            .withColumn("keywords", F.when(user, matched_keywords(body, policy.blocked_keywords))
                        .otherwise(none))
            .withColumn("injection", user & has_injection(body))
            .withColumn("pii_types", F.array_sort(F.array_distinct(
                F.transform("spans", lambda s: s["type"]))))
            .withColumn("n_values", F.size(F.array_distinct(
                F.transform("spans", lambda s: s["value"]))))
            .withColumn("n_spans", F.size("spans")))


def number_messages(scanned: DataFrame, conv: str = "conv_id", turn: str = "turn",
                    text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Sanitised messages and the token table, numbered over the whole conversation.

    Numbering each message alone would give two originals one placeholder, and the reply
    could not be restored.
    """
    rows = span_rows(scanned, [conv, turn])
    tokens = assign_placeholders(rows, [conv], turn, token_prefix, gateway_placeholder)
    return apply_placeholders(scanned, tokens, [conv, turn], [conv], text), tokens


def number_each_message(scanned: DataFrame, text: str = "text") -> DataFrame:
    """Sanitised messages, each numbered alone: no shuffle."""
    return scanned.withColumn("_tokens", token_map(F.col("spans"))).withColumn(
        "sanitized_text", redact_with_tokens(text_or_empty(text), F.col("spans"),
                                             F.col("_tokens"))).drop("_tokens")


def decide(scanned: DataFrame, policy: Policy = Policy(), conv: str = "conv_id",
           zero_knowledge: Column | None = None) -> DataFrame:
    """One decision per conversation.

    Only counts, a boolean per keyword and the set of the types found are aggregated, all
    of them combined before the shuffle, so a conversation of any length is cheap. Types
    are whatever the spans say, those of outside spans too; there are few of them.
    """
    zk = F.lit(False) if zero_knowledge is None else F.coalesce(zero_knowledge, F.lit(False))
    words = [F.bool_or(F.array_contains("keywords", k)).alias(f"_k{i}")
             for i, k in enumerate(policy.blocked_keywords)]
    g = scanned.groupBy(conv).agg(
        F.count("*").alias("n_messages"), F.bool_or("injection").alias("injection"),
        F.sum("n_values").alias("n_values"), F.sum("n_spans").alias("n_spans"),
        F.bool_or(zk).alias("zero_knowledge"), F.collect_set("pii_types").alias("_types"), *words)
    empty = F.array().cast("array<string>")
    keywords = F.array_compact(F.array(*[
        F.when(F.col(f"_k{i}"), F.lit(k)) for i, k in enumerate(policy.blocked_keywords)
    ])) if words else empty
    found = F.array_sort(F.array_distinct(F.flatten("_types")))
    g = g.withColumn("keywords", keywords).withColumn("_found", F.when(
        F.col("zero_knowledge"), F.array(F.lit("CLIENT_SIDE_ENCRYPTED"))).otherwise(found))
    t = threat(F.col("injection"), F.col("_found"))
    blocked = F.size("keywords") > 0
    g = g.withColumn("_threat", t)
    stopped = F.col("_threat.action") != "FORWARDED"
    types = (F.when(blocked, F.array(F.lit("CONFIDENTIAL_BLACK_KEYWORD")))
             .when(stopped, F.concat("_found", F.array(F.concat(
                 F.lit("THREAT_"), F.col("_threat.risk_level")))))
             .otherwise(F.col("_found")))
    count = (F.when(blocked, 0)
             .when(F.col("zero_knowledge"), F.when(stopped, 0).otherwise(1))
             .otherwise(F.col("n_values")))
    return g.select(
        conv, "n_messages", "zero_knowledge", "keywords", "injection", "n_spans",
        F.when(blocked, "BLOCKED").otherwise(F.col("_threat.action")).alias("action"),
        F.when(~blocked, F.col("_threat.risk_level")).alias("risk_level"),
        F.when(~blocked, F.col("_threat.score")).alias("risk_score"),
        F.when(~blocked, F.col("_threat.reasons")).alias("reasons"),
        types.alias("pii_types_detected"), count.cast("bigint").alias("tokens_redacted_count"))


def joined_prompts(messages: DataFrame, conv: str = "conv_id", turn: str = "turn",
                   role: str = "role", text: str = "text") -> DataFrame:
    """User turns joined by line breaks, in order: (conv, text), one row for a conversation.

    A joined prompt is one value, so a conversation's user texts must fit in a task.
    """
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("turn"),
                                                   F.col(text).alias("text"))))
    return (messages.filter(F.col(role) == "user").groupBy(conv)
            .agg(F.array_join(F.transform(ordered, lambda t: t["text"]), "\n").alias("text")))


def audit_records(decisions: DataFrame, prompts: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Audit rows: each decision with its sanitised prompt, one row for a conversation.

    The prompt of a blocked conversation is the sanitised one, never the raw one.
    """
    d = decisions.join(prompts.withColumnRenamed("text", "_prompt"), conv, "left")
    prompt = F.coalesce(F.col("_prompt"), F.lit(""))
    blocked, stopped = F.size("keywords") > 0, F.col("action") != "FORWARDED"
    head = (F.when(blocked, F.concat(
                F.lit("[BLOCKED BY CONFIDENTIAL BLACKLIST KEYWORD: "),
                F.array_join("keywords", ", "), F.lit("] "), prompt))
            .when(stopped, F.concat(
                F.lit("[BLOCKED BY THREAT ENGINE: "), F.array_join("reasons", ", "),
                F.lit("] "), prompt))
            .when(prompt == "", F.lit(PRE_SANITIZED)).otherwise(prompt))
    return d.select(conv, "action", "risk_level", "pii_types_detected", "tokens_redacted_count",
                    head.alias("sanitized_prompt"))


def ledger_records(records: DataFrame, options: DataFrame, conv: str = "conv_id",
                   client: str = "anonymous") -> DataFrame:
    """Audit rows with all columns of the ledger, from records and request options.

    ``options`` has the model of each request and, if known, ``client_identifier`` and
    ``proxy_latency_ms``; the id is made of the conversation, the time is that of writing.
    """
    known = {c: F.col(c) for c in ("client_identifier", "proxy_latency_ms") if c in options.columns}
    chosen = options.select(
        conv, F.col("model").alias("upstream_model"),
        F.coalesce(known.get("client_identifier", F.lit(None).cast("string")), F.lit(client))
        .alias("client_identifier"),
        F.coalesce(known.get("proxy_latency_ms", F.lit(None)).cast("double"), F.lit(0.0))
        .alias("proxy_latency_ms"))
    return records.join(chosen, conv, "left").select(
        F.md5(F.concat_ws(":", F.lit("audit"), F.col(conv).cast("string"))).alias("id"),
        F.current_timestamp().alias("created_at"),
        F.coalesce("client_identifier", F.lit(client)).alias("client_identifier"),
        "pii_types_detected", F.col("tokens_redacted_count").cast("int").alias("tokens_redacted_count"),
        "proxy_latency_ms", "sanitized_prompt", "upstream_model")
