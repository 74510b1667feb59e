"""Headline queries at one scale; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose input and
cores. Texts are spread over the cores once, since the test tables are single files.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession, functions as F

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))

SHUFFLED = {"session_redaction": "r3_session_redaction", "leak_check": "r12_leaks",
            "keyword_table": "j2_keyword_table", "reply_stream": "t5_reply_stream"}
SHUFFLED_SECONDS = 300


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
             .config("spark.driver.memory", "20g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .config("spark.sql.shuffle.partitions", str(CPUS))
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    from suite import data as d, detect, ledger as _ledger, redaction  # noqa: F401
    from suite.registry import QUERIES
    from veilframe.operators import audit
    from veilframe.operators.counts import redactions_per_type
    from veilframe.operators.tokens import assign_placeholders, span_rows
    from veilframe.plans.client import client_scan, combined_scan, with_entities
    from veilframe.plans.conversation import decide, scan_messages
    from veilframe.plans.gateway import gateway_scan
    from veilframe.sources.texts import spread

    docs = spread(d.table(spark, SF_DIR, "documents").select(
        "doc_id", F.col("source").alias("session"), "text"), CPUS * 4)
    prompts = spread(d.prompts(spark, SF_DIR), CPUS * 4)
    chat = spread(d.table(spark, SF_DIR, "conversations").select(
        "conv_id", "turn", "role", "text"), CPUS * 4)
    ledger = d.audit(spark, SF_DIR)

    runs = {
        "client_documents": lambda: client_scan(docs),
        "gateway_documents": lambda: gateway_scan(docs),
        "entities_documents": lambda: with_entities(docs),
        "combined_documents": lambda: combined_scan(docs),
        "types_documents": lambda: redactions_per_type(client_scan(docs)),
        "gateway_prompts": lambda: gateway_scan(prompts),
        "client_prompts": lambda: client_scan(prompts),
        "session_tokens": lambda: assign_placeholders(
            span_rows(gateway_scan(docs), ["doc_id", "session"]), ["session"], "doc_id"),
        "conversation_decisions": lambda: decide(scan_messages(chat)),
        "audit_totals": lambda: audit.totals(ledger),
        "audit_timeline": lambda: audit.timeline(ledger, unit="hour"),
    }
    # One run over the smallest input compiles the shared code; it is not counted.
    gateway_scan(chat.limit(10)).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name, build in runs.items():
        started = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    # The queries that shuffle most; they do not count in the total, and stop when time is up.
    shuffled, began = {}, time.perf_counter()
    for name, query in SHUFFLED.items():
        if time.perf_counter() - began > SHUFFLED_SECONDS:
            break
        started = time.perf_counter()
        QUERIES[query](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        shuffled[name] = round(time.perf_counter() - started, 3)
    n_prompts = prompts.count()
    n_chars = docs.agg(F.sum(F.length("text"))).first()[0]
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "shuffled_queries": shuffled, "sf": os.path.basename(SF_DIR.rstrip("/")),
        "gateway_prompts_per_sec": round(n_prompts / seconds["gateway_prompts"]),
        "client_chars_per_sec": round(n_chars / seconds["client_documents"]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
