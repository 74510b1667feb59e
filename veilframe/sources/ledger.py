"""Writing the audit ledger: append, JSON and CSV exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veilframe.lineage import stored


def stamp(records: DataFrame) -> DataFrame:
    """Give records an id and a creation time where they have none."""
    columns = records.columns
    if "id" not in columns:
        records = records.withColumn("id", F.uuid())
    if "created_at" not in columns:
        records = records.withColumn("created_at", F.current_timestamp())
    return records


def append_audit(records: DataFrame, path: str, by_date: bool = True) -> None:
    """Append to the Parquet ledger, one folder per day, so time filters prune folders.

    Safe to repeat: of the records, those whose id the ledger has (in the folders of their days,
    which are the only ones read) are left out, and an id that comes twice is written once. A
    run that fails leaves its files in a staging folder that no reader sees, and its repetition
    adds what is missing. Records that get their id here are new each time. One writer at a time.
    """
    spark = records.sparkSession
    stamped = stamp(records).dropDuplicates(["id"])
    day = ["audit_date"] if by_date else []
    if by_date:
        stamped = stamped.withColumn("audit_date", F.to_date("created_at"))
    if stored(spark, path):
        held = spark.read.parquet(path).select("id", *day)
        stamped = stamped.join(held, ["id", *day], "left_anti")
    stamped.write.mode("append").partitionBy(*day).parquet(path)


def export_json(ledger: DataFrame, path: str) -> None:
    ledger.write.mode("overwrite").json(path)


# Column titles in order.
CSV_TITLES = (
    ("id", "ID"), ("created_at", "Timestamp"), ("client_identifier", "Client IP"),
    ("pii_types_detected", "PII Types"), ("tokens_redacted_count", "Tokens Redacted"),
    ("proxy_latency_ms", "Latency (ms)"), ("upstream_model", "Upstream Model"),
    ("sanitized_prompt", "Sanitized Prompt"),
)


def csv_rows(ledger: DataFrame) -> DataFrame:
    """The eight renamed columns; types joined by semicolons."""
    return ledger.select(*[
        (F.array_join(name, ";") if name == "pii_types_detected" else F.col(name)).alias(title)
        for name, title in CSV_TITLES])


def export_csv(ledger: DataFrame, path: str) -> None:
    (csv_rows(ledger).write.mode("overwrite").option("header", True)
     .option("quote", '"').option("escape", '"').csv(path))
