"""Sessions and ledgers that go on, cursors, sweeps, long chains, and streams with late and silent input."""

import json
import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from veilframe.lineage import shared_folder
from veilframe.operators import audit
from veilframe.operators.entities import drop_known, drop_overlapping_rows, group_tags, place_entities
from veilframe.operators.overlap import longest_first
from veilframe.operators.substrings import check_outgoing, substring_hits
from veilframe.operators.tokens import assign_placeholders, continue_session
from veilframe.sources.ledger import append_audit
from veilframe.streaming import prompts as sp, replies as sr

SPAN = "doc_id long, session string, start int, value string, type string"


def test_session_goes_on_and_repeats_add_nothing(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("st"), rng.randint(0, 30), f"v{rng.randint(0, 40)}", rng.choice("AB")) for i in range(200)]
    early, late, all_ = (spark.createDataFrame(r, SPAN) for r in (rows[:90], rows[90:], rows))
    path = shared_folder(spark)
    first = {tuple(r) for r in continue_session(early, path, ["session"], "doc_id").collect()}
    continue_session(late, path, ["session"], "doc_id")
    after = {tuple(r) for r in continue_session(late, path, ["session"], "doc_id").collect()}
    whole = assign_placeholders(all_, ["session"], "doc_id")
    assert first < after == {tuple(r) for r in whole.select("session", "placeholder", "original", "kind", "n", "issued").collect()}


def test_first_leak_is_the_first_issued(spark):
    tokens = spark.createDataFrame(
        [("s", f"[REDACTED_A_{i}]", f"secret{i}x", i) for i in range(1, 12)], "session string, placeholder string, original string, issued long")
    texts = spark.createDataFrame([(1, "s", "secret10x and secret2x"), (2, "s", "clean"), (3, "t", "secret2x"), (4, "s", None)],
                                  "doc_id long, session string, text string")
    got = {r["doc_id"]: (r["safe"], r["leaked_placeholder"], r["n_leaks"]) for r in check_outgoing(texts, tokens, ["doc_id"], ["session"]).collect()}
    assert got == {1: (False, "[REDACTED_A_2]", 2), 2: (True, None, 0), 3: (True, None, 0), 4: (True, None, 0)}


def test_substrings_in_long_texts_and_other_planes(spark):
    """Needles across the border of two pieces of a text, and of characters outside the basic plane."""
    long_text = "x" * 65_530 + "needle😀end" + "y" * 70_000
    texts = spark.createDataFrame([(1, long_text), (2, "😀😀a"), (3, "")], "doc_id long, text string")
    needles = spark.createDataFrame([("needle😀end",), ("le😀",), ("😀a",), ("😀",), ("zzzz",), ("xy",)], "needle string")
    got = {(r["doc_id"], r["needle"]) for r in substring_hits(texts, needles, ["doc_id"]).collect()}
    assert got == {(1, "needle😀end"), (1, "le😀"), (1, "😀"), (2, "😀a"), (2, "😀")}


def test_append_is_safe_to_repeat(spark):
    rows = [(f"r{i}", datetime(2026, 1, 1 + i % 3, i % 24)) for i in range(30)]
    df = spark.createDataFrame(rows, "id string, created_at timestamp")
    path = shared_folder(spark)
    for batch in (df.filter("id < 'r2'"), df, df.unionByName(df)):
        append_audit(batch, path)
    assert spark.read.parquet(path).count() == spark.read.parquet(path).select("id").distinct().count() == 30


def test_pages_by_cursor(spark):
    """Every page by cursor, and the cursor behind any number of records, over ties in time."""
    rows = [(f"r{i:03d}", datetime(2026, 1, 1) + timedelta(hours=i // 7 * 5, seconds=i // 3 % 2)) for i in range(90)]
    path = shared_folder(spark)
    append_audit(spark.createDataFrame(rows, "id string, created_at timestamp"), path)
    ledger = spark.read.parquet(path)
    want = [i for i, _ in sorted(rows, key=lambda r: (-r[1].timestamp(), r[0]))]
    got, after = [], None
    for _ in range(4):
        page = audit.ledger_page(ledger, 25, after=after).orderBy(F.desc("created_at"), "id").collect()
        got += [r["id"] for r in page]
        after = (page[-1]["created_at"], page[-1]["id"])
    assert got == want
    for offset in (1, 8, 44, 90):
        assert audit.page_cursor(ledger, offset)[1] == want[offset - 1]
    assert audit.page_cursor(ledger, 0) is None and audit.page_cursor(ledger, 91) is None
    plan = audit.ledger_page(ledger, 25, after=after)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(audit_date" in plan


def test_sweeps_equal_pairwise_tests(spark):
    rng = random.Random(4)
    made = lambda n: [(rng.randint(0, 3), s, s + rng.randint(1, 30), rng.choice("PL")) for s in (rng.choice([rng.randint(0, 400), 65_536 + rng.randint(-40, 40)]) for _ in range(n))]
    one, two = made(300), made(60)
    schema = "doc_id long, start int, end int, type string"
    a, b = spark.createDataFrame(one, schema), spark.createDataFrame(two, schema)
    got = sorted(tuple(r) for r in drop_overlapping_rows(a, b, ["doc_id"]).collect())
    assert got == sorted(x for x in one if not any(x[0] == y[0] and x[1] < y[2] and x[2] > y[1] for y in two))
    got = sorted(tuple(r) for r in drop_known(a, b, ["doc_id"]).collect())
    assert got == sorted(x for x in one if not any(x[0] == y[0] and (x[1:3] == y[1:3] or (y[1] <= x[1] and y[2] >= x[2] and x[3] == y[3])) for y in two))


def test_long_chain_of_overlaps(spark):
    """20,000 spans of which each touches the next: as the pairwise greedy choice, and soon done."""
    def greedy(spans):
        kept = []
        for s in sorted(range(len(spans)), key=lambda i: (spans[i][0] - spans[i][1], i)):
            if not any(spans[s][0] < spans[k][1] and spans[s][1] > spans[k][0] for k in kept):
                kept.append(s)
        return sorted(spans[k] for k in kept)

    rng = random.Random(6)
    small = [(s, s + rng.randint(3, 9)) for s in sorted(rng.randint(0, 900) for _ in range(400))]
    df = spark.createDataFrame([([{"start": a, "end": b} for a, b in small],)], "spans array<struct<start:int,end:int>>")
    got = [(s["start"], s["end"]) for s in df.select(longest_first(F.col("spans")).alias("s")).first()["s"]]
    assert got == greedy(small)
    chain = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(19_999)), lambda i: F.struct(
        (i * 2).alias("start"), (i * 2 + 3 + i % 3).alias("end"))).alias("spans"))
    began = time.perf_counter()
    n = chain.select(F.size(longest_first(F.col("spans"))).alias("n")).first()["n"]
    assert n > 6_000 and time.perf_counter() - began < 30


def test_kth_mention_takes_kth_place(spark):
    text = "Ann met Bob. Ann saw Ann Lee, then ann left"
    tags = [("Ann", "B-PER"), ("Bob", "B-PER"), ("Ann", "B-PER"), ("Ann", "B-PER"), ("##Lee", "I-PER"), ("Zoe", "B-PER"), ("ann", "B-PER")]
    rows = [(1, i, w, e, 0.9) for i, (w, e) in enumerate(tags)]
    found = place_entities(group_tags(spark.createDataFrame(rows, "doc_id long, pos int, word string, entity string, score double"), ["doc_id"]),
                           spark.createDataFrame([(1, text), (2, "no tags")], "doc_id long, text string"), ["doc_id"])
    got = [(r["start"], r["end"], r["text"]) for r in found.orderBy("first_pos").collect()]
    assert got == [(0, 3, "Ann"), (8, 11, "Bob"), (13, 16, "Ann"), (21, 28, "Ann Lee"), (0, 3, "Ann"), (35, 38, "ann")]


def event(content):
    return "data: " + json.dumps({"choices": [{"delta": {"content": content}}]})


def test_replies_out_of_order_and_without_end(spark):
    """Lines scattered over two triggers, a repeated line, a reply that falls silent behind a gap."""
    path = shared_folder(spark)
    at = lambda second: datetime(2026, 1, 1) + timedelta(seconds=second)
    batches = [
        [("a", 1, event("CTED_EMAIL_1] an"), at(0)), ("a", 3, "data: [DONE]", at(0)), ("b", 0, event("whole [REDACTED_EMAIL_1]"), at(0)),
         ("b", 1, "data: [DONE]", at(0)), ("c", 0, event("open [REDACTED_"), at(1)), ("c", 2, event("late"), at(1))],
        [("a", 0, event("hi [REDA"), at(2)), ("a", 1, event("CTED_EMAIL_1] an"), at(2)), ("a", 2, event("d end ["), at(2)), ("x", 0, ": keep-alive", at(900))],
    ]
    tokens = spark.createDataFrame([(s, "[REDACTED_EMAIL_1]", f"{s}@x.com") for s in "abc"], "stream_id string, placeholder string, original string")
    for rows in batches:
        spark.createDataFrame(rows, "stream_id string, seq int, line string, arrived timestamp").coalesce(1).write.mode("append").parquet(f"{path}/lines")
        lines = spark.readStream.schema("stream_id string, seq int, line string, arrived timestamp").parquet(f"{path}/lines")
        sr.rehydrate_stream(lines, tokens, f"{path}/out", f"{path}/state", time="arrived").awaitTermination()
    out = {}
    for r in spark.read.parquet(f"{path}/out").orderBy("stream_id", "seq").collect():
        out[r["stream_id"]] = out.get(r["stream_id"], "") + r["rehydrated"]
    assert out == {"a": "hi a@x.com and end [", "b": "whole b@x.com", "c": "open [REDACTED_late"}


def test_windows_by_upsert_leave_late_records_out(spark):
    path = shared_folder(spark)
    at = lambda minute: datetime(2026, 1, 1) + timedelta(minutes=minute)
    for minutes in ([5, 10, 70], [200, 210], [15, 215]):  # 15 is behind the watermark by then
        spark.createDataFrame([(at(m),) for m in minutes], "created_at timestamp").coalesce(1).write.mode("append").parquet(f"{path}/in")
        events = spark.readStream.schema("created_at timestamp").parquet(f"{path}/in")
        sp.upsert_counts(sp.windowed_counts(events), f"{path}/out", f"{path}/state").awaitTermination()
    got = {r["window_start"].hour: r["n"] for r in spark.read.parquet(f"{path}/out").collect()}
    assert got == {0: 2, 1: 1, 3: 3}


def test_two_sinks_and_a_replayed_batch(spark):
    path = shared_folder(spark)
    spark.createDataFrame([(i, "x" * (i * 10)) for i in range(8)], "id long, body string").coalesce(1).write.parquet(f"{path}/in")
    events = spark.readStream.schema("id long, body string").parquet(f"{path}/in")
    for state in ("one", "two"):  # a lost checkpoint runs batch 0 again, over what it wrote before
        sp.ingest_receipts(events, f"{path}/out", f"{path}/{state}", limit=60, normal=False).awaitTermination()
    good, bad = (sorted(r["id"] for r in spark.read.parquet(f"{path}/out/{n}").select("id").collect()) for n in ("accepted", "rejected"))
    assert sorted(good + bad) == list(range(8)) and good and bad and max(good) < min(bad)
