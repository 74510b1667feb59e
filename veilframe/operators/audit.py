"""Queries over the audit ledger and over receipts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def newest(df: DataFrame, n: int | None, time: str = "created_at", tie: str = "id") -> DataFrame:
    """The newest ``n`` records (all when None): a top-k, never a full sort."""
    return df if n is None else df.orderBy(F.desc(time), F.asc(tie)).limit(n)


def newest_per(df: DataFrame, by: Sequence[str], n: int, time: str = "created_at",
               tie: str = "id") -> DataFrame:
    """The newest ``n`` records per group.

    The rank filter is pushed into the sort of each partition before the shuffle, so a
    large group ships at most ``n`` records per task.
    """
    w = Window.partitionBy(*by).orderBy(F.desc(time), F.asc(tie))
    return df.withColumn("_rank", F.row_number().over(w)).filter(
        F.col("_rank") <= n).drop("_rank")


def ledger_filter(df: DataFrame, pii_type: str | None = None,
                  search: str | None = None) -> DataFrame:
    """Type membership, and case-insensitive search in prompt, client and model."""
    if pii_type and pii_type != "ALL":
        df = df.filter(F.array_contains("pii_types_detected", pii_type))
    if search:
        wanted = search.lower()
        df = df.filter(F.lower("sanitized_prompt").contains(wanted)
                       | F.lower("client_identifier").contains(wanted)
                       | F.lower("upstream_model").contains(wanted))
    return df


def ledger_page(df: DataFrame, limit: int = 50, pii_type: str | None = None,
                search: str | None = None, after: tuple | None = None) -> DataFrame:
    """One page of the ledger, newest first; ``after`` is the (created_at, id) that the page before ended with.

    However deep the page, a task keeps ``limit`` records. With a ledger that has a folder for each day, only
    the folders up to the cursor's day are read. (``page_cursor`` turns a number of records to skip into a cursor.)
    """
    df = ledger_filter(df, pii_type, search)
    if after is not None:
        time, last = F.lit(after[0]), F.lit(after[1])
        df = df.filter((F.col("created_at") < time) | ((F.col("created_at") == time) & (F.col("id") > last)))
        if "audit_date" in df.columns:
            df = df.filter(F.col("audit_date") <= F.to_date(time))
    return df.orderBy(F.desc("created_at"), F.asc("id")).limit(limit)


def page_cursor(df: DataFrame, offset: int, pii_type: str | None = None,
                search: str | None = None) -> tuple | None:
    """The cursor behind the ``offset`` newest records; None for no offset, or if there are fewer.

    Records are counted by day, then by hour of that day, then by second of that hour; these counts come to the
    driver, and only records of the cursor's own second are sorted.
    """
    if offset <= 0:
        return None
    df = ledger_filter(df, pii_type, search)
    daily = "audit_date" in df.columns
    for unit in ("day", "hour", "second"):
        bucket = F.col("audit_date").cast("timestamp") if unit == "day" and daily else F.date_trunc(unit, "created_at")
        counts = df.groupBy(bucket.alias("at")).agg(F.count("*").alias("n")).orderBy(F.desc("at")).collect()
        for row in counts:
            if row["n"] >= offset:
                break
            offset -= row["n"]
        else:
            return None
        df = df.filter(bucket == F.lit(row["at"]))
        if unit == "day" and daily:
            df = df.filter(F.col("audit_date") == F.lit(row["at"]).cast("date"))
    skipped = df.select("created_at", "id").orderBy(F.desc("created_at"), F.asc("id")).limit(offset)
    return tuple(skipped.orderBy("created_at", F.desc("id")).first())


def ledger_total(df: DataFrame, pii_type: str | None = None,
                 search: str | None = None) -> DataFrame:
    return ledger_filter(df, pii_type, search).agg(F.count("*").alias("total"))


def totals(df: DataFrame, cap: int | None = None) -> DataFrame:
    """Requests, redacted tokens and mean latency to one digit."""
    return newest(df, cap).agg(
        F.count("*").alias("total_requests"),
        F.coalesce(F.sum("tokens_redacted_count"), F.lit(0)).alias("total_tokens_redacted"),
        F.coalesce(F.round(F.avg("proxy_latency_ms"), 1), F.lit(0.0)).alias("avg_latency_ms"))


def type_breakdown(df: DataFrame, cap: int | None = None) -> DataFrame:
    """Requests per detected type."""
    return (newest(df, cap).select(F.explode("pii_types_detected").alias("pii_type"))
            .groupBy("pii_type").agg(F.count("*").alias("n")))


def type_shares(df: DataFrame, cap: int | None = None) -> DataFrame:
    """Requests per type and their rounded percentage of all redacted tokens."""
    kept = newest(df, cap)
    total = kept.agg(F.coalesce(F.sum("tokens_redacted_count"), F.lit(0)).alias("t")).scalar()
    return type_breakdown(kept).select(
        "pii_type", "n",
        F.round(F.col("n") * 100 / F.greatest(F.lit(1), total), 0)
        .cast("bigint").alias("percent"))


def timeline(df: DataFrame, cap: int | None = None, unit: str = "minute",
             by_clock: bool = False) -> DataFrame:
    """Records per ``unit`` of calendar time, oldest first; ``cap`` looks at the newest only.

    ``by_clock`` counts by the minute of the day (HH:mm), as the dashboard does.
    """
    kept = newest(df, cap)
    if by_clock:
        bucket = F.date_format("created_at", "HH:mm")
        return (kept.groupBy(bucket.alias("time"))
                .agg(F.count("*").alias("n"), F.min("created_at").alias("_first"))
                .orderBy("_first").select("time", "n"))
    return (kept.groupBy(F.date_trunc(unit, "created_at").alias("time"))
            .agg(F.count("*").alias("n")).orderBy("time"))


def running_counters(receipts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Requests, redactions, threats blocked and image scans; batch or streaming."""
    n = F.coalesce(F.col("tokenCount"), F.lit(0))
    image = (F.col("source").contains("OCR") if "source" in receipts.columns
             else F.lit(False))
    return receipts.groupBy(*by).agg(
        F.count("*").alias("total_requests"), F.sum(n).alias("total_redactions"),
        F.count_if(n > 0).alias("threats_blocked"),
        F.count_if(image).alias("ocr_scans"))


def mean_risk(receipts: DataFrame, score: str = "riskScore") -> DataFrame:
    """Mean risk score to one digit; missing or zero counts as 90."""
    value = F.coalesce(F.nullif(F.col(score), F.lit(0)), F.lit(90))
    return receipts.agg(F.round(F.avg(value), 1).alias("avg_risk"))


def high_confidence_share(df: DataFrame, tokens: str = "spans") -> DataFrame:
    """Tokens, tokens with confidence of 98 or more (missing or 0: 99), and the percentage.

    An empty ledger reports 99.6.
    """
    raw = F.explode_outer(F.transform(tokens, lambda t: F.coalesce(
        F.when(t["confidence"] != 0, t["confidence"]), F.lit(99.0))))
    c = df.select(raw.alias("c")).filter(F.col("c").isNotNull())
    return c.agg(F.count("*").alias("n_tokens"), F.count_if(F.col("c") >= 98).alias("n_high")
                 ).withColumn("percent", F.when(F.col("n_tokens") > 0, F.round(
                     F.col("n_high") * 100 / F.col("n_tokens"), 1)).otherwise(F.lit(99.6)))


def compliance_summary(df: DataFrame) -> DataFrame:
    """Prompts, tokens and mean latency (missing or 0: 0.4)."""
    latency = F.coalesce(F.when(F.col("proxy_latency_ms") != 0, F.col("proxy_latency_ms")),
                         F.lit(0.4))
    return df.agg(F.count("*").alias("prompts"),
                  F.coalesce(F.sum("tokens_redacted_count"), F.lit(0)).alias("tokens"),
                  F.coalesce(F.avg(latency), F.lit(0.0)).alias("avg_latency_ms"))


def compliance_rows(df: DataFrame) -> DataFrame:
    """Detail rows of the compliance report, as formatted text."""
    latency = F.coalesce(F.when(F.col("proxy_latency_ms") != 0, F.col("proxy_latency_ms")),
                         F.lit(0.35))
    types = F.array_join("pii_types_detected", ", ")
    return df.select(
        F.concat(F.substring("id", 1, 8), F.lit("...")).alias("request_id"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.when(types == "", "None").otherwise(types).alias("detected_pii"),
        F.coalesce("tokens_redacted_count", F.lit(0)).cast("string").alias("redacted"),
        F.concat(F.format_string("%.2f", latency), F.lit(" ms")).alias("proxy_overhead"),
        F.lit("BLOCKED FROM LLM").alias("status"))


def lookup(df: DataFrame, ids: DataFrame | Sequence[str] | str, id_: str = "id") -> DataFrame:
    """Ledger records by transaction id: one, a few, or a table of ids."""
    if isinstance(ids, str):
        return df.filter(F.col(id_) == ids)
    if isinstance(ids, DataFrame):
        return df.join(ids.select(id_), id_, "left_semi")
    return df.filter(F.col(id_).isin(*ids))


def by_vendor(df: DataFrame, vendor: Column) -> DataFrame:
    return df.groupBy(vendor.alias("vendor")).agg(F.count("*").alias("n"))
