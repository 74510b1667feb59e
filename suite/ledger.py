"""Queries on sources, the audit ledger, receipts, image and tag tables, and streams."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from suite import data as d, sqlgen as g
from suite.detect import CLIENT_CTES, CORPUS, joined
from suite.redaction import FACTS, GATEWAY, PREFIX_SQL, T, numbered
from suite.registry import query
from veilframe.lineage import cut_lineage, shared_folder
from veilframe.functions.language import vendor_of
from veilframe.functions.checksums import luhn_valid, register_validator
from veilframe.operators import audit as a, entities as ent, ocr
from veilframe.plans import receipts as rc
from veilframe.plans.client import client_scan
from veilframe.plans.policy import Policy
from veilframe.rules.client import CARD, CARD_GATE
from veilframe.rules.model import Rule
from veilframe.sources import chat as chat_source, ledger as ledger_source
from veilframe.streaming import prompts as sp, replies as sr

AUDIT = f"WITH a AS MATERIALIZED ({d.SQL_AUDIT})"
TS = "strftime({c}, '%Y-%m-%d %H:%M:%S')"


def clock(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def scratch(spark: SparkSession) -> str:
    """A new folder for written tables, which all machines share."""
    return shared_folder(spark)


@query("s1_text_input", f"{CORPUS} SELECT doc_id AS id, length(text) AS n_chars FROM corpus "
       "WHERE doc_id < 1000000000")
def s1(spark, sf):
    from veilframe.sources.texts import read_texts

    return read_texts(spark, f"{sf}/documents.parquet", key="doc_id").select(
        "id", F.length("text").cast("bigint").alias("n_chars"))


@query("s2_chat_payload",
       f"WITH c AS ({d.SQL_CHAT}) SELECT conv_id, turn, role, text FROM c")
def s2(spark, sf):
    """Request bodies made of each turn, half with plain content and half with parts."""
    turns = d.chat(spark, sf)
    plain = F.to_json(F.struct(F.array(F.struct("role", F.col("text").alias("content")))
                               .alias("messages")))
    part = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    parts = F.to_json(F.struct(F.array(F.struct("role", F.array(part).alias("content")))
                               .alias("messages")))
    bodies = turns.select(
        F.concat_ws("/", "conv_id", "turn").alias("request"), "conv_id",
        F.col("turn").alias("n"), F.when(F.col("turn") % 2 == 0, plain).otherwise(parts)
        .alias("body"))
    out = chat_source.explode_chat(bodies, "request").withColumn(
        "ids", F.split("request", "/"))
    return out.select(F.col("ids")[0].cast("bigint").alias("conv_id"),
                      F.col("ids")[1].cast("bigint").alias("turn"), "role", "text")


@query("s2_joined_prompts",
       f"WITH c AS ({d.SQL_CHAT}) SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS prompt "
       "FROM c WHERE role = 'user' GROUP BY conv_id")
def s2_prompts(spark, sf):
    from veilframe.plans.conversation import joined_prompts

    return joined_prompts(d.chat(spark, sf)).select("conv_id", F.col("text").alias("prompt"))


def event_lines(texts, key="stream_id"):
    """Each text as streamed lines: one JSON event per 11 characters, then the end mark."""
    # Cut in one pass, before there are rows: rows that carry their text and a place in it take time by its square.
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{d.CHUNK}}}"), F.lit(0))
    pieces = F.when(F.length("text") > 0, cut).otherwise(F.array("text"))
    ended = F.concat(F.transform(pieces, lambda p: F.struct(p.alias("content"), F.lit(False).alias("end"))),
                     F.array(F.struct(F.lit(None).cast("string").alias("content"), F.lit(True).alias("end"))))
    delta = F.to_json(F.struct(F.array(F.struct(F.struct(
        F.col("_p.content").alias("content")).alias("delta"))).alias("choices")))
    return texts.select(key, F.posexplode(ended).alias("seq", "_p")).select(
        key, "seq", F.when(F.col("_p.end"), "data: [DONE]").otherwise(F.concat(F.lit("data: "), delta)).alias("line"))


@query("s3_event_lines", f"{CORPUS} SELECT doc_id AS stream_id, text FROM corpus WHERE text <> ''")
def s3(spark, sf):
    texts = d.corpus(spark, sf).select(F.col("doc_id").alias("stream_id"), "text")
    chunks = event_lines(texts).select("stream_id", "seq", F.concat("line", F.lit("\n\n"))
                                       .alias("chunk"))
    lines = chat_source.event_lines(chunks)
    return chat_source.reply_texts(lines).filter(F.col("text") != "").select("stream_id", "text")


@query("s6_audit_append",
       f"{AUDIT} SELECT strftime(created_at, '%Y-%m-%d') AS audit_date, "
       "count(*) AS n, CAST(sum(tokens_redacted_count) AS BIGINT) AS tokens FROM a GROUP BY 1")
def s6(spark, sf):
    path = scratch(spark)
    records = d.audit(spark, sf)
    even = records.filter(F.col("tokens_redacted_count") % 2 == 0)
    for batch in (even, records, even):  # what is there already is not added again
        ledger_source.append_audit(batch, path)
    return spark.read.parquet(path).groupBy(
        F.col("audit_date").cast("string").alias("audit_date")).agg(
        F.count("*").alias("n"), F.sum("tokens_redacted_count").alias("tokens"))


LEDGER_COLUMNS = ("id, client_identifier, sanitized_prompt, tokens_redacted_count, types, upstream_model, "
                  "proxy_latency_ms, " + TS.format(c="created_at") + " AS created_at")


@query("s7_json_export", f"{AUDIT} SELECT {LEDGER_COLUMNS} FROM a")
def s7(spark, sf):
    path = scratch(spark)
    records = d.audit(spark, sf)
    ledger_source.export_json(records, path)
    back = spark.read.schema(records.schema).json(path)
    return back.withColumns({"types": joined("pii_types_detected"), "created_at": clock("created_at")}).drop(
        "pii_types_detected")


@query("s8_csv_export",
       f"WITH q AS ({AUDIT} SELECT {LEDGER_COLUMNS} FROM a) SELECT id AS \"ID\", created_at AS \"Timestamp\", "
       "client_identifier AS \"Client IP\", types AS \"PII Types\", tokens_redacted_count AS \"Tokens Redacted\", "
       "proxy_latency_ms AS \"Latency (ms)\", upstream_model AS \"Upstream Model\", sanitized_prompt AS "
       "\"Sanitized Prompt\" FROM q")
def s8(spark, sf):
    path = scratch(spark)
    ledger_source.export_csv(d.audit(spark, sf), path)
    back = (spark.read.option("header", True).option("escape", '"').csv(path))
    return back.withColumns({
        "PII Types": F.coalesce("PII Types", F.lit("")), "Timestamp": clock(F.to_timestamp("Timestamp")),
        "Tokens Redacted": F.col("Tokens Redacted").cast("int"), "Latency (ms)": F.col("`Latency (ms)`").cast("double")})


OCR_LINES = (
    f"WITH t AS ({d.SQL_OCR}), a AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY image_id "
    "ORDER BY y, x, text) > 15 THEN 1 ELSE 0 END AS down FROM t), b AS (SELECT *, sum(down) OVER "
    "(PARTITION BY image_id ORDER BY y, x, text ROWS UNBOUNDED PRECEDING) AS line FROM a)")


@query("s9_image_text",
       f"{OCR_LINES} SELECT image_id, string_agg(text, chr(10) ORDER BY line, x, y, text) AS text, "
       "round(avg(confidence), 1) AS confidence, count(*) AS n_tokens FROM b GROUP BY image_id")
def s9(spark, sf):
    return ocr.image_text(ocr.reading_order(d.ocr_tokens(spark, sf)))


@query("w5_reading_order",
       f"{OCR_LINES} SELECT image_id, text, x, y, CAST(line AS BIGINT) AS line, row_number() OVER "
       "(PARTITION BY image_id ORDER BY line, x, y, text) AS \"rank\" FROM b")
def w5(spark, sf):
    return ocr.reading_order(d.ocr_tokens(spark, sf)).select(
        "image_id", "text", F.col("bbox.x").alias("x"), F.col("bbox.y").alias("y"), "line",
        F.col("rank").cast("bigint").alias("rank"))


TAGS = (
    f"WITH t AS (SELECT *, substr(entity, 3) AS type FROM ({d.SQL_TAGS}) q), a AS (SELECT *, CASE "
    "WHEN starts_with(entity, 'B-') OR lag(type) OVER w IS DISTINCT FROM type THEN 1 ELSE 0 END AS "
    "st FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos, word)), b AS (SELECT *, sum(st) OVER "
    "(PARTITION BY doc_id ORDER BY pos, word ROWS UNBOUNDED PRECEDING) AS isl FROM a)")


@query("w6_tag_groups",
       f"{TAGS} SELECT doc_id, min(pos) AS first_pos, any_value(type) AS type, string_agg("
       "regexp_replace(word, '^##', ''), '' ORDER BY pos, word) AS text FROM b "
       "GROUP BY doc_id, isl")
def w6(spark, sf):
    return ent.group_tags(d.tags(spark, sf), ["doc_id"]).select(
        "doc_id", "first_pos", "type", "text")


#: One text for each order: the tagged words one after the other, in few forms, so that most come again.
SQL_MENTIONS = (
    "SELECT doc_id, pos, entity, substr(entity, 3) AS type, concat('N', cast(n AS VARCHAR)) AS word, 2 + "
    "length(cast(n AS VARCHAR)) AS width FROM (SELECT l_orderkey AS doc_id, l_linenumber * 10000000000 + l_suppkey * 1000000 + l_partkey AS pos, "
    "concat(CASE WHEN l_suppkey % 3 = 0 THEN 'B-' ELSE 'I-' END, CASE l_partkey % 3 WHEN 0 THEN 'PER' WHEN 1 THEN "
    "'LOC' ELSE 'ORG' END) AS entity, l_partkey % 4 AS n FROM lineitem) q")


@query("w6_entity_offsets",
       f"WITH t AS ({SQL_MENTIONS}), a AS (SELECT *, CASE WHEN starts_with(entity, 'B-') OR lag(type) OVER w IS "
       "DISTINCT FROM type THEN 1 ELSE 0 END AS st, coalesce(sum(width) OVER (PARTITION BY doc_id ORDER BY pos, word "
       "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY "
       "pos, word)), b AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY pos, word ROWS UNBOUNDED PRECEDING) AS "
       "isl FROM a) SELECT doc_id, min(pos) AS first_pos, CAST(min(s) AS INT) AS start_at, CAST(max(s + width - 1) AS "
       "INT) AS end_at FROM b GROUP BY doc_id, isl")
def w6_offsets(spark, sf):
    """The k-th mention of a name takes its k-th place in the text."""
    tags = d.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 10000000000 + F.col("l_suppkey") * 1000000 + F.col("l_partkey")).alias("pos"),
        F.concat(F.lit("N"), (F.col("l_partkey") % 4).cast("string")).alias("word"),
        F.concat(F.when(F.col("l_suppkey") % 3 == 0, "B-").otherwise("I-"), F.element_at(
            F.array(F.lit("PER"), F.lit("LOC"), F.lit("ORG")), (F.col("l_partkey") % 3 + 1).cast("int"))).alias("entity"),
        F.lit(None).cast("double").alias("score"))
    texts = tags.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("pos", "word"))), lambda t: t["word"]), " ").alias("text"))
    return ent.place_entities(ent.group_tags(tags, ["doc_id"]), texts, ["doc_id"]).select(
        "doc_id", "first_pos", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query("a13_entity_scores",
       f"{TAGS} SELECT doc_id, min(pos) AS first_pos, string_agg(regexp_replace(word, '^##', ''), '' "
       "ORDER BY pos, word) AS text, round(avg(coalesce(score, 0.95)) * 100, 1) AS confidence FROM b "
       "GROUP BY doc_id, isl")
def a13(spark, sf):
    return ent.group_tags(d.tags(spark, sf), ["doc_id"]).select(
        "doc_id", "first_pos", "text", "confidence")


@query("a5_totals",
       f"{AUDIT} SELECT count(*) AS total_requests, CAST(sum(tokens_redacted_count) AS BIGINT) AS "
       "total_tokens_redacted, round(avg(proxy_latency_ms), 1) AS avg_latency_ms FROM a")
def a5(spark, sf):
    return a.totals(d.audit(spark, sf))


@query("a5_totals_newest",
       f"{AUDIT} SELECT count(*) AS total_requests, CAST(sum(tokens_redacted_count) AS BIGINT) AS "
       "total_tokens_redacted, round(avg(proxy_latency_ms), 1) AS avg_latency_ms FROM (SELECT * FROM "
       "a ORDER BY created_at DESC, id LIMIT 1000) q")
def a5_newest(spark, sf):
    return a.totals(d.audit(spark, sf), cap=1000)


SPLIT_TYPES = ("t AS (SELECT unnest(string_split(types, ';')) AS pii_type FROM a WHERE types <> '')")


@query("a6_type_breakdown",
       f"{AUDIT}, {SPLIT_TYPES} SELECT pii_type, count(*) AS n FROM t GROUP BY 1")
def a6(spark, sf):
    return a.type_breakdown(d.audit(spark, sf))


@query("a7_type_shares",
       f"{AUDIT}, {SPLIT_TYPES}, s AS (SELECT sum(tokens_redacted_count) AS total FROM a) SELECT "
       "pii_type, count(*) AS n, CAST(round(count(*) * 100 / greatest(1, (SELECT total FROM s)), 0) "
       "AS BIGINT) AS \"percent\" FROM t GROUP BY 1")
def a7(spark, sf):
    return a.type_shares(d.audit(spark, sf))


@query("a8_timeline",
       f"{AUDIT} SELECT strftime(date_trunc('hour', created_at), '%Y-%m-%d %H:%M:%S') AS time, "
       "count(*) AS n FROM a GROUP BY 1")
def a8(spark, sf):
    return a.timeline(d.audit(spark, sf), unit="hour").select(
        clock("time").alias("time"), "n")


@query("a8_timeline_newest",
       f"{AUDIT} SELECT strftime(created_at, '%H:%M') AS time, count(*) AS n FROM (SELECT * FROM a "
       "ORDER BY created_at DESC, id LIMIT 30) q GROUP BY 1")
def a8_newest(spark, sf):
    return a.timeline(d.audit(spark, sf), cap=30, by_clock=True)


RECEIPTS = f"WITH r AS MATERIALIZED ({d.SQL_RECEIPTS})"
COUNTERS_SQL = ("count(*) AS total_requests, CAST(sum(coalesce(tokenCount, 0)) AS BIGINT) AS "
                "total_redactions, count(*) FILTER (tokenCount > 0) AS threats_blocked, count(*) "
                "FILTER (contains(source, 'OCR')) AS ocr_scans")


@query("a9_counters", f"{RECEIPTS} SELECT {COUNTERS_SQL} FROM r")
def a9(spark, sf):
    return a.running_counters(d.receipts(spark, sf))


@query("a10_mean_risk",
       f"{RECEIPTS} SELECT round(avg(coalesce(nullif(riskScore, 0), 90)), 1) AS avg_risk FROM r")
def a10(spark, sf):
    return a.mean_risk(d.receipts(spark, sf))


@query("a11_high_confidence",
       f"{CLIENT_CTES} SELECT count(*) AS n_tokens, count(*) FILTER (k.type <> 'PHONE') AS n_high, "
       "round(count(*) FILTER (k.type <> 'PHONE') * 100 / count(*), 1) AS \"percent\" FROM k")
def a11(spark, sf):
    return a.high_confidence_share(client_scan(d.corpus(spark, sf)))


@query("a12_compliance_summary",
       f"{AUDIT} SELECT count(*) AS prompts, CAST(sum(tokens_redacted_count) AS BIGINT) AS tokens, "
       "round(avg(coalesce(nullif(proxy_latency_ms, 0), 0.4)), 4) AS avg_latency_ms FROM a")
def a12(spark, sf):
    return a.compliance_summary(d.audit(spark, sf)).withColumn(
        "avg_latency_ms", F.round("avg_latency_ms", 4))


@query("a12_compliance_rows",
       f"{AUDIT} SELECT substr(id, 1, 8) || '...' AS request_id, {TS.format(c='created_at')} AS "
       "\"timestamp\", CASE WHEN types = '' THEN 'None' ELSE replace(types, ';', ', ') END AS "
       "detected_pii, CAST(tokens_redacted_count AS VARCHAR) AS redacted, printf('%.2f', "
       "coalesce(nullif(proxy_latency_ms, 0), 0.35)) || ' ms' AS proxy_overhead, 'BLOCKED FROM LLM' "
       "AS status FROM a")
def a12_rows(spark, sf):
    return a.compliance_rows(d.audit(spark, sf))


@query("w3_ledger_page",
       f"{AUDIT} SELECT id, {TS.format(c='created_at')} AS created_at, client_identifier FROM a "
       "WHERE list_contains(string_split(types, ';'), 'EMAIL') AND (contains(lower("
       "sanitized_prompt), 'click') OR contains(lower(client_identifier), 'click') OR "
       "contains(lower(upstream_model), 'click')) ORDER BY a.created_at DESC, id LIMIT 50 OFFSET 20")
def w3(spark, sf):
    """The page behind the first 20 records, by a cursor, from a ledger with a folder for each day."""
    path = scratch(spark)
    ledger_source.append_audit(d.audit(spark, sf), path)
    ledger = spark.read.parquet(path)
    after = a.page_cursor(ledger, 20, "EMAIL", "CLICK")
    return a.ledger_page(ledger, 50, "EMAIL", "CLICK", after).select(
        "id", clock("created_at").alias("created_at"), "client_identifier")


@query("w3_ledger_total",
       f"{AUDIT} SELECT count(*) AS total FROM a WHERE list_contains(string_split(types, ';'), "
       "'EMAIL') AND contains(lower(upstream_model), 'gemini')")
def w3_total(spark, sf):
    return a.ledger_total(d.audit(spark, sf), "EMAIL", "Gemini")


@query("w4_newest_receipts",
       f"{RECEIPTS} SELECT txId, {TS.format(c='ts')} AS ts FROM r ORDER BY r.ts DESC, txId LIMIT 50")
def w4(spark, sf):
    return a.newest(d.receipts(spark, sf), 50, "ts", "txId").select(
        "txId", clock("ts").alias("ts"))


@query("w4_newest_per_source",
       f"{RECEIPTS} SELECT txId, coalesce(source, '') AS source FROM r QUALIFY row_number() OVER "
       "(PARTITION BY source ORDER BY ts DESC, txId) <= 50")
def w4_source(spark, sf):
    return a.newest_per(d.receipts(spark, sf), ["source"], 50, "ts", "txId").select(
        "txId", F.coalesce("source", F.lit("")).alias("source"))


@query("j7_ledger_lookup",
       f"{AUDIT} SELECT id, client_identifier FROM a WHERE id IN (SELECT 'req-' || p_partkey FROM "
       "part WHERE p_size > 25)")
def j7(spark, sf):
    wanted = d.table(spark, sf, "part").filter("p_size > 25").select(
        F.concat(F.lit("req-"), F.col("p_partkey").cast("string")).alias("id"))
    return a.lookup(d.audit(spark, sf), wanted).select("id", "client_identifier")


@query("f16_vendor",
       f"{AUDIT} SELECT CASE WHEN contains(upstream_model, 'claude') THEN 'claude' WHEN "
       "contains(upstream_model, 'gemini') THEN 'gemini' WHEN contains(upstream_model, 'deepseek') "
       "THEN 'deepseek' WHEN contains(upstream_model, 'perplexity') THEN 'perplexity' ELSE 'chatgpt' "
       "END AS vendor, count(*) AS n FROM a GROUP BY 1")
def f16(spark, sf):
    return a.by_vendor(d.audit(spark, sf), vendor_of(F.col("upstream_model")))


NORMAL_SQL = (
    "SELECT txId AS id, CASE WHEN coalesce(source, '') = '' THEN 'EXTENSION' ELSE source END AS "
    "source, CASE WHEN types = '' THEN 'CLEAN_SCAN' ELSE types END AS entities, coalesce(tokenCount, "
    "0) AS tokenCount, coalesce(language, 'en') AS language, coalesce(riskLevel, 'MEDIUM') AS "
    "riskLevel, coalesce(riskScore, 50) AS riskScore FROM r")


def normal(df):
    return df.select("id", "source", joined(F.col("entities_found")).alias("entities"),
                     "tokenCount", "language", "riskLevel", "riskScore")


@query("c9_receipts", f"{RECEIPTS} {NORMAL_SQL}")
def c9(spark, sf):
    return normal(rc.normalise(d.receipts(spark, sf)))


@query("c9_receipts_of_scans",
       f"{CLIENT_CTES}, x AS (SELECT doc_id, count(*) AS n FROM k GROUP BY doc_id) SELECT 'tx_' || "
       "c.doc_id AS \"txId\", CAST(coalesce(n, 0) AS INT) AS \"tokenCount\", CASE WHEN "
       "regexp_matches(text, '[ऀ-ॿ]') THEN 'hi' ELSE 'en' END AS language FROM corpus c LEFT JOIN x "
       "ON x.doc_id = c.doc_id")
def c9_scans(spark, sf):
    return rc.receipts_of(client_scan(d.corpus(spark, sf)), "doc_id").select(
        "txId", "tokenCount", "language")


TEST_CARD = Rule("STARTING_4", CARD, "word", "word", check="luhn_visa", gate=CARD_GATE,
                 label="[CARD_4]", signal="numeric")


@query("u1_custom_validator",
       f"{CORPUS}, f AS MATERIALIZED (SELECT doc_id, 0 AS ord, i, s, e, v, 'STARTING_4' AS type, '[CARD_4]' AS label "
       f"FROM ({g.spans_of(g.re2(TEST_CARD), keep=g.luhn_sql('v'))}) r WHERE starts_with(v, '4')), "
       f"a AS MATERIALIZED (SELECT * FROM f UNION ALL {g.entropy_spans('f')}), k AS MATERIALIZED "
       f"({g.resolve('a', 'longest')}) SELECT doc_id, count(*) AS n FROM k WHERE k.k.type = 'STARTING_4' "
       "GROUP BY doc_id")
def u1(spark, sf):
    """Spans of a rule with the user's own check that the client pipeline keeps: not those inside a longer secret."""
    register_validator("luhn_visa", lambda v: luhn_valid(v) & v.startswith("4"))
    df = client_scan(d.corpus(spark, sf), rules=(TEST_CARD,))
    mine = F.size(F.filter("spans", lambda s: s["type"] == "STARTING_4")).cast("bigint")
    return df.select("doc_id", mine.alias("n")).filter("n > 0")


@query("u4_policy_update",
       f"{CORPUS} SELECT doc_id, contains(lower(text), 'clean prompt') OR contains(lower(text), "
       "'notes') AS blocked FROM corpus")
def u4(spark, sf):
    from veilframe.operators.keywords import matched_keywords

    policy = Policy().updated(blocked_keywords=["Clean Prompt", "notes", "notes"])
    return d.corpus(spark, sf).select("doc_id", (F.size(matched_keywords(
        F.col("text"), policy.blocked_keywords)) > 0).alias("blocked"))


# Streams. Each runs until its input is used up and returns what its sink holds.
def finish(stream, path, mode="append"):
    q = (stream.writeStream.format("parquet").outputMode(mode)
         .option("checkpointLocation", path + "-state").trigger(availableNow=True).start(path))
    q.awaitTermination()


def as_stream(spark, sf, name):
    schema = d.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}*.parquet")


CHAT_BASE = 2 * d.PROMPT_BASE
SQL_STREAMED = (f"{d.SQL_CORPUS} UNION ALL SELECT {CHAT_BASE} + conv_id * 1000 + turn AS doc_id, '' AS session, text "
                "FROM conversations")


@query("t1_prompt_stream",
       f"{CORPUS.replace(d.SQL_CORPUS, SQL_STREAMED)}, {GATEWAY[len(CORPUS) + 2:]}, {numbered(PREFIX_SQL)}, "
       f"o AS ({g.splice('corpus', 'z')}), {FACTS}, b AS (SELECT *, contains(lower(text), 'projectmanhattan') AS "
       f"blocked FROM x) SELECT b.doc_id, CASE WHEN blocked THEN 'BLOCKED' ELSE {T['action']} END AS action, CASE WHEN "
       f"NOT blocked THEN {T['score']} END AS risk_score, n_values, o.out AS sanitized_text FROM b JOIN o ON "
       "o.doc_id = b.doc_id")
def t1(spark, sf):
    """Documents, prompts made of orders and the turns of conversations, as one stream."""
    path = scratch(spark)
    orders = as_stream(spark, sf, "orders").select(
        (F.col("o_orderkey") + d.PROMPT_BASE).alias("doc_id"),
        F.expr(d.PROMPT_TEXT).alias("text"))
    documents = as_stream(spark, sf, "documents").select("doc_id", "text")
    turns = as_stream(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn") + CHAT_BASE).alias("doc_id"), "text")
    stream = orders.unionByName(documents).unionByName(turns)
    names = ["doc_id", "action", "risk_score", "n_values", "sanitized_text"]
    finish(sp.decide_prompts(stream).select(*names), path)
    return spark.read.parquet(path).withColumn("n_values", F.col("n_values").cast("bigint"))


@query("t2_receipt_stream", f"{RECEIPTS} {NORMAL_SQL}")
def t2(spark, sf):
    path = scratch(spark)
    sp.ingest_receipts(d.receipts_from(as_stream(spark, sf, "events")), path, path + "-state").awaitTermination()
    return normal(spark.read.parquet(path + "/accepted"))


PAYLOAD = "strlen(CAST(to_json(struct_pack(event_id := event_id, props := props)) AS VARCHAR)) > 35"


@query("t2_rejected_receipts", f"SELECT event_id, {PAYLOAD} AS rejected FROM events")
def t2_rejected(spark, sf):
    """Both sinks of one run: every event is in one of them."""
    path = scratch(spark)
    slim = as_stream(spark, sf, "events").select("event_id", "props")
    sp.ingest_receipts(slim, path, path + "-state", limit=35, normal=False).awaitTermination()
    sinks = [spark.read.parquet(f"{path}/{name}").select("event_id", F.lit(name == "rejected").alias("rejected"))
             for name in ("accepted", "rejected")]
    return sinks[0].unionByName(sinks[1])


@query("t3_running_counters", f"{RECEIPTS} SELECT coalesce(language, '') AS language, {COUNTERS_SQL} "
       "FROM r GROUP BY 1")
def t3(spark, sf):
    path = scratch(spark)
    counted = sp.counters(d.receipts_from(as_stream(spark, sf, "events")), ["language"])

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/latest")
    (counted.writeStream.outputMode("complete").foreachBatch(write)
     .option("checkpointLocation", path + "-state").trigger(availableNow=True).start()
     .awaitTermination())
    return spark.read.parquet(f"{path}/latest").withColumn(
        "language", F.coalesce("language", F.lit("")))


@query("t4_windowed_timeline",
       "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n "
       "FROM events GROUP BY 1")
def t4(spark, sf):
    path = scratch(spark)
    days = sp.windowed_counts(as_stream(spark, sf, "events"), "ts", "1 day")
    sp.upsert_counts(days, path, path + "-state").awaitTermination()
    return spark.read.schema("window_end timestamp, n long, window_start timestamp").parquet(path).select(
        clock("window_start").alias("window_start"), "n")


#: Replies that lack their end mark, and those whose lines come out of order and over two triggers.
UNENDED, SCATTERED = "doc_id % 10 = 3", "doc_id % 8 = 0"


@query("t5_reply_stream",
       f"WITH corpus AS ({SQL_STREAMED}) SELECT CAST(doc_id AS VARCHAR) AS stream_id, text FROM corpus WHERE text <> ''")
def t5(spark, sf):
    """Sanitised documents, prompts and turns streamed back in small chunks, restored across chunk borders.

    Some replies never end, and the odd lines of some come a trigger before the even ones.
    """
    from veilframe.plans.gateway import gateway_scan

    path = scratch(spark)
    turns = d.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn") + CHAT_BASE).alias("doc_id"), "text")
    texts = d.corpus(spark, sf).select("doc_id", "text").unionByName(turns)
    done = gateway_scan(texts).select("doc_id", F.col("sanitized_text").alias("text"), "token_map")
    done.write.parquet(path + "-masked")
    masked = spark.read.parquet(path + "-masked")
    lines = event_lines(masked, "doc_id").filter(f"NOT ({UNENDED} AND line = 'data: [DONE]')").withColumn(
        "early", F.expr(f"NOT ({SCATTERED}) OR seq % 2 = 1")).select(
        F.col("doc_id").cast("string").alias("stream_id"), "seq", "line", "early")
    tokens = masked.select(F.col("doc_id").cast("string").alias("stream_id"),
                           F.explode("token_map").alias("placeholder", "original"))
    # A line that only says that the connection lives, an hour later: by then silent replies are closed.
    alive = spark.range(1).select(F.lit("").alias("stream_id"), F.lit(0).alias("seq"), F.lit(": keep-alive").alias("line"),
                                  F.lit(False).alias("early"), F.lit(3600).alias("second"))
    second = F.when(F.col("early"), 0).otherwise(1)
    arrived = lines.withColumn("second", second).unionByName(alive).withColumn(
        "arrived", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("second"))).drop("second")
    for early in (True, False):  # the second run goes on from the first one's checkpoint
        arrived.filter(F.col("early") == early).drop("early").write.mode("append").parquet(path + "-lines")
        source = spark.readStream.schema("stream_id string, seq int, line string, arrived timestamp").parquet(
            path + "-lines")
        sr.rehydrate_stream(source, tokens, path, path + "-state", time="arrived").awaitTermination()
    pieces = F.array_sort(F.collect_list(F.struct("seq", "rehydrated")))
    return spark.read.parquet(path).groupBy(F.col("stream_id").cast("string").alias("stream_id")
                                            ).agg(F.array_join(F.transform(
                                                pieces, lambda p: p["rehydrated"]), "")
                                                .alias("text"))
