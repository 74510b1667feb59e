"""Streams of prompts, telemetry receipts and their counters and timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veilframe.columns import text_or_empty
from veilframe.functions.quality import RECEIPT_LIMIT_BYTES
from veilframe.operators.audit import running_counters
from veilframe.operators.keywords import matched_keywords
from veilframe.operators.spans import has_injection
from veilframe.operators.threat import threat
from veilframe.plans.gateway import gateway_scan
from veilframe.plans.policy import Policy
from veilframe.plans.receipts import accepted, normalise, rejected


def decide_prompts(prompts: DataFrame, policy: Policy = Policy(), text: str = "text"
                   ) -> DataFrame:
    """Redact and decide each prompt by itself: stateless, for batch and streams alike."""
    df = gateway_scan(prompts, text, policy.profile)
    df = df.withColumn("keywords", matched_keywords(text_or_empty(text),
                                                    policy.blocked_keywords))
    df = df.withColumn("_threat", threat(has_injection(text_or_empty(text)),
                                         F.col("pii_types")))
    blocked = F.size("keywords") > 0
    return (df.withColumn("action", F.when(blocked, "BLOCKED").otherwise(
                F.col("_threat.action")))
            .withColumn("risk_score", F.when(~blocked, F.col("_threat.score")))
            .drop("_threat", "spans", "matches", text))


def split_receipts(receipts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Normalised receipts within the size limit, and the rejected ones, as two sinks."""
    return normalise(accepted(receipts)), rejected(receipts)


def ingest_receipts(receipts: DataFrame, path: str, checkpoint: str, limit: int = RECEIPT_LIMIT_BYTES,
                    normal: bool = True):
    """Start a query that reads receipts once and fills two sinks, ``path/accepted`` and ``path/rejected``.

    A micro-batch is kept while both are written. Each sink has a folder for each batch
    number, so a batch that is run again replaces what its first attempt wrote and adds nothing.
    It runs until its input is used up.
    """
    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            good = accepted(kept, limit)
            (normalise(good) if normal else good).write.mode("overwrite").parquet(
                f"{path}/accepted/batch={number}")
            rejected(kept, limit).write.mode("overwrite").parquet(f"{path}/rejected/batch={number}")
        finally:
            kept.unpersist()
    return (receipts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def counters(receipts: DataFrame, by=()) -> DataFrame:
    """Running counters; write them with output mode update or complete."""
    return running_counters(receipts, by)


def windowed_counts(events: DataFrame, time: str = "created_at", width: str = "1 hour",
                    lateness: str = "10 minutes", by=()) -> DataFrame:
    """Records per tumbling window of event time; late records beyond the mark are left out."""
    stamped = events.withColumn("_ts", F.col(time).cast("timestamp"))
    return (stamped.withWatermark("_ts", lateness)
            .groupBy(F.window("_ts", width), *by).agg(F.count("*").alias("n"))
            .select(F.col("window.start").alias("window_start"),
                    F.col("window.end").alias("window_end"), *by, "n"))


def upsert_counts(counts: DataFrame, path: str, checkpoint: str, keys=("window_start",)):
    """Start a query that keeps the newest count of every window under ``path``, and its state small.

    ``counts`` is from :func:`windowed_counts`. Update mode sends only the windows that a micro-batch changed, and
    windows behind the watermark leave the state; a full count never has to be kept or sent. Each
    key has a folder of its own, which its newest count replaces, so a batch that is run
    again changes nothing. It runs until its input is used up.
    """
    def write(batch: DataFrame, number: int) -> None:
        (batch.repartition(*keys).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path))
    return (counts.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
