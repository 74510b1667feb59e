"""Queries on overlap resolution, redaction, placeholders, rehydration, joins, pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import data as d, sqlgen as g
from suite.detect import (
    CLIENT_CTES, CORPUS, ENTITY_CTES, KIND_SQL, PREFIX_SQL, gateway_ctes, gateway_found, joined,
)
from suite.registry import CHECKS, query
from veilframe.functions.labels import token_prefix
from veilframe.lineage import cut_lineage, shared_folder
from veilframe.operators import entities as ent, external as ext
from veilframe.operators.counts import redactions_per_type, types_per_scope
from veilframe.operators.keywords import keyword_hits, matched_keywords
from veilframe.operators.knowledge import knowledge_matches, matches_as_spans
from veilframe.operators.overlap import drop_known_entities
from veilframe.operators.redact import (
    items_token_map, redact_entities, redact_fallback, sequential_counter,
)
from veilframe.operators.rehydrate import (
    merge_token_maps, rehydrate, rehydrate_from_map, rehydrate_json,
)
from veilframe.operators.spans import entity_spans, knowledge_tokens
from veilframe.operators.substrings import check_outgoing, find_leaks
from veilframe.operators.tokens import (
    assign_placeholders, continue_session, gateway_placeholder, replace_spans, span_rows,
)
from veilframe.plans.client import client_scan, combined_scan, with_client_spans, with_entities
from veilframe.plans.conversation import (
    audit_records, decide, joined_prompts, ledger_records, number_each_message, number_messages,
    scan_messages,
)
from veilframe.plans.documents import image_text_gate
from veilframe.plans.gateway import gateway_scan, leftmost_scan, with_gateway_spans
from veilframe.plans.session import intercept
from veilframe.rules import CLIENT_RULES, COUNTER_STAGES, EXPLAINED_STAGES, ENTITY_RULES, fallback_rules
from veilframe.rules.local import LEFTMOST_PERSONAL, LEFTMOST_SECRETS
from veilframe.rules.model import add_view
from veilframe.sources.chat import chat_options, explode_chat
from veilframe.sources.ledger import append_audit
from veilframe.sources.lists import load_knowledge, load_keywords

GATEWAY = f"{CORPUS}, {gateway_ctes()}"
KEPT = "SELECT doc_id, k.type AS type, k.v AS value, k.s AS s, k.e AS e FROM k"


def kept_rows(df, spans="spans"):
    return span_rows(df, ["doc_id"], spans).select(
        "doc_id", "type", "value", F.col("start").alias("s"), F.col("end").alias("e"))


@query("w1_leftmost", f"{GATEWAY} {KEPT}")
def w1(spark, sf):
    return kept_rows(with_gateway_spans(d.corpus(spark, sf)))


START_RULES = LEFTMOST_SECRETS + LEFTMOST_PERSONAL
LOCAL_CTES = (f"{CORPUS}, a AS MATERIALIZED ({g.rule_spans(START_RULES)}), "
              f"k AS MATERIALIZED ({g.resolve('a', 'start')})")


@query("w1_leftmost_start_only", f"{LOCAL_CTES} {KEPT}")
def w1_start(spark, sf):
    return kept_rows(leftmost_scan(d.corpus(spark, sf)))


@query("w2_longest_first", f"{CLIENT_CTES} {KEPT}")
def w2(spark, sf):
    return kept_rows(with_client_spans(d.corpus(spark, sf)))


@query("w7_text_order",
       f"{GATEWAY} SELECT doc_id, string_agg(k.v, ';' ORDER BY k.s) AS values_in_order "
       "FROM k GROUP BY doc_id")
def w7(spark, sf):
    return gateway_scan(d.corpus(spark, sf)).filter(F.col("n_spans") > 0).select(
        "doc_id", joined(F.transform("matches", lambda m: m["value"])).alias("values_in_order"))


@query("r1_static_labels",
       f"{CLIENT_CTES}, o AS ({g.splice('corpus', 'k')}) SELECT doc_id, out AS sanitized_text "
       "FROM o")
def r1(spark, sf):
    return client_scan(d.corpus(spark, sf)).select("doc_id", "sanitized_text")


def numbered(prefix_sql: str) -> str:
    """CTEs t (token per value of a text) and z (kept spans with their tokens)."""
    return (
        "t AS MATERIALIZED (SELECT doc_id, v, '[' || prefix || '_REDACTED_' || row_number() OVER "
        "(PARTITION BY doc_id, prefix ORDER BY far DESC) || ']' AS ph FROM (SELECT doc_id, k.v AS "
        f"v, max(k.s) AS far, {prefix_sql.format(t='arg_max(k.type, k.s)')} AS prefix FROM k "
        "GROUP BY doc_id, k.v) q), "
        "z AS MATERIALIZED (SELECT k.doc_id, struct_pack(s := k.k.s, e := k.k.e, v := k.k.v, "
        "type := k.k.type, label := t.ph) AS k FROM k JOIN t ON t.doc_id = k.doc_id "
        "AND t.v = k.k.v)")


@query("r2_numbered_placeholders",
       f"{GATEWAY}, {numbered(PREFIX_SQL)}, o AS ({g.splice('corpus', 'z')}) "
       "SELECT doc_id, out AS sanitized_text FROM o")
def r2(spark, sf):
    return gateway_scan(d.corpus(spark, sf)).select("doc_id", "sanitized_text")


LEFT_PREFIX = ("CASE {t} WHEN 'CREDIT_CARD' THEN 'CARD' WHEN 'DB_CONNECTION_STRING' THEN 'DB_CONN' "
               "WHEN 'PHI_NAME' THEN 'NAME' ELSE {t} END")


@query("r6_leftmost_sanitiser",
       f"{LOCAL_CTES}, {numbered(LEFT_PREFIX)}, o AS ({g.splice('corpus', 'z')}) "
       "SELECT doc_id, out AS sanitized_text FROM o")
def r6(spark, sf):
    return leftmost_scan(d.corpus(spark, sf)).select("doc_id", "sanitized_text")


def session_ctes(kept: str, kind_sql: str, scope: str = "session", order: str = "doc_id",
                 style: str = "'[REDACTED_' || kind || '_' || n || ']'") -> str:
    """CTEs m (token table of each scope) from rows doc_id, scope, s, e, v, type."""
    return (
        f"w AS MATERIALIZED ({kept}), "
        f"y AS (SELECT {scope}, v, far, s, {kind_sql.format(t='type')} AS kind FROM (SELECT {scope}, "
        f"v, {order} AS far, s, upper(regexp_replace(type, '^NER_', '')) AS type, row_number() OVER "
        f"(PARTITION BY {scope}, v ORDER BY {order}, s DESC) AS r FROM w) q WHERE r = 1), "
        f"m AS MATERIALIZED (SELECT {scope}, v, kind, n, issued, {style} AS ph FROM (SELECT {scope}, v, "
        f"kind, row_number() OVER (PARTITION BY {scope}, kind ORDER BY far, s DESC) AS n, row_number() OVER "
        f"(PARTITION BY {scope} ORDER BY far, s DESC) AS issued FROM y) q)")


CLIENT_ROWS = ("SELECT k.doc_id, c.session, k.k.s AS s, k.k.e AS e, k.k.v AS v, k.k.type AS type "
               "FROM k JOIN corpus c ON c.doc_id = k.doc_id")
SESSION = f"{CLIENT_CTES}, {session_ctes(CLIENT_ROWS, KIND_SQL)}"
SESSION_KEPT = ("sk AS MATERIALIZED (SELECT w.doc_id, struct_pack(s := w.s, e := w.e, label := m.ph)"
                " AS k FROM w JOIN m ON m.session = w.session AND m.v = w.v)")


def session_tokens(spark, sf):
    """Span rows of all texts, written without the texts, and the token table of their sessions."""
    rows = cut_lineage(span_rows(with_client_spans(d.corpus(spark, sf)), ["doc_id", "session"]))
    return rows, assign_placeholders(rows, ["session"], "doc_id")


def session_redaction(spark, sf, rows, tokens):
    return replace_spans(d.corpus(spark, sf), rows, tokens, ["doc_id"], ["session"])


@query("r3_session_tokens",
       f"{SESSION} SELECT session, ph AS placeholder, v AS original FROM m")
def r3_tokens(spark, sf):
    return session_tokens(spark, sf)[1].select("session", "placeholder", "original")


SHARED = f"{CLIENT_CTES}, {session_ctes(CLIENT_ROWS.replace('c.session', 'c.doc_id % 3 AS session'), KIND_SQL)}"


@query("r3_session_append",
       f"{SHARED} SELECT session, ph AS placeholder, v AS original, n, issued FROM m")
def r3_append(spark, sf):
    """Three sessions over documents and then prompts, the prompts twice: as one run over all of them."""
    found = with_client_spans(d.corpus(spark, sf)).withColumn("session", F.col("doc_id") % 3)
    rows = cut_lineage(span_rows(found, ["doc_id", "session"]))
    path = shared_folder(spark)
    early, late = rows.filter(F.col("doc_id") < d.PROMPT_BASE), rows.filter(F.col("doc_id") >= d.PROMPT_BASE)
    for batch in (early, late, late):
        tokens = continue_session(batch, path, ["session"], "doc_id")
    return tokens.select("session", "placeholder", "original", "n", "issued")


@query("r3_session_redaction",
       f"{SESSION}, {SESSION_KEPT}, o AS ({g.splice('corpus', 'sk')}) "
       "SELECT doc_id, out AS sanitized_text FROM o")
def r3(spark, sf):
    rows, tokens = session_tokens(spark, sf)
    return session_redaction(spark, sf, rows, tokens).select("doc_id", "sanitized_text")


def staged(stages) -> str:
    """CTEs of a sequential sanitiser: each stage works on the text of the one before."""
    ctes = [f"corpus AS MATERIALIZED ({d.SQL_CORPUS})",
            "c0 AS MATERIALIZED (SELECT doc_id, text, 0 AS n FROM corpus)"]
    for i, stage in enumerate(stages):
        rule, prefix = stage[0], stage[1]
        keep = {"": "true", "luhn_digits": g.luhn_sql("v", "[^0-9]"),
                "lenient_card": f"({g.luhn_sql('v', '[^0-9]')} OR "
                                f"length({g.digits_of('v')}) IN (15, 16))"}[rule.check]
        ctes.append(f"h{i} AS MATERIALIZED ({g.spans_of(g.re2(rule), f'c{i}', 'doc_id, n', keep)})")
        ctes.append(f"k{i} AS MATERIALIZED (SELECT doc_id, struct_pack(s := s, e := e, label := "
                    f"'[{prefix}_REDACTED_' || (n + row_number() OVER (PARTITION BY doc_id "
                    f"ORDER BY s)) || ']') AS k FROM h{i})")
        ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT o.doc_id, o.out AS text, b.n + coalesce("
                    f"q.m, 0) AS n FROM ({g.splice(f'c{i}', f'k{i}')}) o JOIN c{i} b ON b.doc_id = "
                    f"o.doc_id LEFT JOIN (SELECT doc_id, count(*) AS m FROM k{i} GROUP BY doc_id) q "
                    "ON q.doc_id = o.doc_id)")
    return "WITH " + ", ".join(ctes)


@query("r4_sequential_counter",
       f"{staged(COUNTER_STAGES)} SELECT doc_id, text AS sanitized, CAST(n AS INT) AS n_items "
       f"FROM c{len(COUNTER_STAGES)}")
def r4(spark, sf):
    return sequential_counter(d.corpus(spark, sf), "text", COUNTER_STAGES).select(
        "doc_id", "sanitized", "n_items")


@query("r5_explained_items",
       f"{staged(EXPLAINED_STAGES)}, it AS (" + " UNION ALL ".join(
           f"SELECT h{i}.doc_id, {i} AS stage, s, {g.quote(stage[2])} AS type, v, {g.quote(stage[3])} AS why FROM h{i}"
           for i, stage in enumerate(EXPLAINED_STAGES)) + "), ag AS (SELECT doc_id, string_agg(type || '=' || v || '(' || "
       "why || ')', ';' ORDER BY stage, s) AS items FROM it GROUP BY doc_id) "
       "SELECT c.doc_id, text AS sanitized, CAST(n AS INT) AS n_items, coalesce(ag.items, '') AS items "
       f"FROM c{len(EXPLAINED_STAGES)} c LEFT JOIN ag ON ag.doc_id = c.doc_id")
def r5(spark, sf):
    df = sequential_counter(d.corpus(spark, sf), "text", EXPLAINED_STAGES)
    return df.select("doc_id", "sanitized", "n_items", joined(F.transform("items", lambda i: F.concat(
        i["type"], F.lit("="), i["original"], F.lit("("), i["explanation"], F.lit(")")))).alias("items"))


def _fallback_sql():
    ctes = [f"corpus AS MATERIALIZED ({d.SQL_CORPUS})",
            "c0 AS (SELECT doc_id, text FROM corpus)"]
    rules = fallback_rules()
    for i, r in enumerate(rules):
        ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT doc_id, regexp_replace(text, "
                    f"{g.quote(g.re2(r))}, {g.quote(r.label)}, 'g') AS text FROM c{i})")
    last = f"c{len(rules)}"
    level = f"{g.entropy_sql('v')} > 3.7"
    ctes.append(f"h AS (SELECT doc_id, arg_min(v, s) AS v FROM ("
                f"{g.spans_of(g.TOKEN_RE2, last, keep=f'{g.MIXED} AND {level}')}) q GROUP BY doc_id)")
    at = "instr(c.text, h.v)"
    return ("WITH " + ", ".join(ctes) + " SELECT c.doc_id, CASE WHEN h.v IS NULL THEN c.text ELSE "
            f"substr(c.text, 1, {at} - 1) || '[HIGH_ENTROPY_REDACTED]' || substr(c.text, "
            f"{at} + length(h.v)) END AS sanitized FROM {last} c LEFT JOIN h ON h.doc_id = c.doc_id")


@query("r7_fallback", _fallback_sql())
def r7(spark, sf):
    return redact_fallback(d.corpus(spark, sf), "text").select("doc_id", "sanitized")


@query("r8_entity_labels",
       f"{ENTITY_CTES}, z AS (SELECT doc_id, struct_pack(s := k.s, e := k.e, label := CASE k.type "
       "WHEN 'PER' THEN '<person>' WHEN 'LOC' THEN '[LOCATION_REDACTED]' ELSE "
       f"'[ORGANIZATION_REDACTED]' END) AS k FROM k), o AS ({g.splice('corpus', 'z')}) "
       "SELECT doc_id, out AS sanitized_text FROM o")
def r8(spark, sf):
    return with_entities(d.corpus(spark, sf)).select("doc_id", redact_entities(
        F.col("text"), F.col("entities"), {"PER": "<person>"}).alias("sanitized_text"))


ALL_TEXT = f"{CORPUS} SELECT doc_id, text AS rehydrated FROM corpus"


@query("r9_rehydrate_session", ALL_TEXT)
def r9(spark, sf):
    rows, tokens = session_tokens(spark, sf)
    tokens = cut_lineage(tokens)
    out = cut_lineage(session_redaction(spark, sf, rows, tokens).select("doc_id", "session", "sanitized_text"))
    return rehydrate(out, tokens, ["doc_id"], ["session"], "sanitized_text").select(
        "doc_id", "rehydrated")


@query("r9_rehydrate_map", ALL_TEXT)
def r9_map(spark, sf):
    return gateway_scan(d.corpus(spark, sf)).select("doc_id", rehydrate_from_map(
        F.col("sanitized_text"), F.col("token_map")).alias("rehydrated"))


@query("r9_rehydrate_items", ALL_TEXT)
def r9_items(spark, sf):
    df = sequential_counter(d.corpus(spark, sf), "text", COUNTER_STAGES)
    df = df.withColumn("tokens", items_token_map(F.reverse("items")))
    return df.select("doc_id", rehydrate_from_map(
        F.col("sanitized"), F.col("tokens")).alias("rehydrated"))


@query("r10_rehydrate_json", ALL_TEXT)
def r10(spark, sf):
    df = gateway_scan(d.corpus(spark, sf))
    payload = F.to_json(F.struct(F.array(F.struct(F.struct(
        F.col("sanitized_text").alias("content")).alias("message"))).alias("choices")))
    df = df.withColumn("payload", payload)
    return df.select("doc_id", F.get_json_object(rehydrate_json(
        F.col("payload"), F.col("token_map")), "$.choices[0].message.content")
        .alias("rehydrated"))


CHAT = ("WITH chat AS MATERIALIZED (SELECT *, conv_id * 1000 + turn AS doc_id FROM "
        f"({d.SQL_CHAT}) x), corpus AS MATERIALIZED (SELECT doc_id, '' AS session, text FROM chat), "
        f"{gateway_ctes()}")
CHAT_ROWS = ("SELECT k.doc_id, c.conv_id, c.turn, k.k.s AS s, k.k.e AS e, k.k.v AS v, "
             "k.k.type AS type FROM k JOIN chat c ON c.doc_id = k.doc_id")
CHAT_TOKENS = session_ctes(CHAT_ROWS, PREFIX_SQL, "conv_id", "turn",
                           "'[' || kind || '_REDACTED_' || n || ']'")


@query("r11_conversation_tokens",
       f"{CHAT}, {CHAT_TOKENS} SELECT conv_id, ph AS placeholder, v AS original FROM m")
def r11(spark, sf):
    rows = span_rows(scan_messages(d.chat(spark, sf)), ["conv_id", "turn"])
    return assign_placeholders(rows, ["conv_id"], "turn", token_prefix,
                               gateway_placeholder).select("conv_id", "placeholder", "original")


@query("r11_merged_maps",
       f"{CHAT}, {numbered(PREFIX_SQL)} SELECT conv_id, ph AS placeholder, arg_max(v, turn) AS "
       "original FROM t JOIN chat c ON c.doc_id = t.doc_id GROUP BY conv_id, ph")
def r11_maps(spark, sf):
    maps = gateway_scan(d.chat(spark, sf))
    return merge_token_maps(maps, ["conv_id"], "turn")


@query("r12_leaks",
       f"{SESSION}, q AS (SELECT doc_id, session, lower(text) AS text FROM corpus) SELECT doc_id, "
       "m.v AS original FROM q JOIN m ON m.session = q.session AND contains(q.text, m.v)")
def r12(spark, sf):
    # The originals of the session tables: where a leak's token is not asked for, nothing is numbered.
    rows = span_rows(with_client_spans(d.corpus(spark, sf)), ["session"])
    tokens = cut_lineage(rows.select("session", F.col("value").alias("original")).distinct())
    texts = d.corpus(spark, sf).select("doc_id", "session", F.lower("text").alias("text"))
    return find_leaks(texts, tokens, ["doc_id"], ["session"]).select("doc_id", "original")


@query("r12_outgoing_check",
       f"{SESSION}, {SESSION_KEPT}, o AS ({g.splice('corpus', 'sk')}), q AS (SELECT o.doc_id, "
       "c.session, o.out AS text FROM o JOIN corpus c ON c.doc_id = o.doc_id), l AS (SELECT "
       "doc_id, count(*) AS n, arg_min(m.v, m.issued) AS v FROM q JOIN m ON m.session = q.session AND "
       "contains(q.text, m.v) GROUP BY doc_id) SELECT q.doc_id, l.n IS NULL AS safe, l.v AS "
       "leaked_token FROM q LEFT JOIN l ON l.doc_id = q.doc_id")
def r12_check(spark, sf):
    rows, tokens = session_tokens(spark, sf)
    tokens = cut_lineage(tokens)
    out = cut_lineage(session_redaction(spark, sf, rows, tokens).select("doc_id", "session", "sanitized_text"))
    return check_outgoing(out, tokens, ["doc_id"], ["session"], "sanitized_text").select(
        "doc_id", "safe", "leaked_token")


LISTED = f"WITH listed AS MATERIALIZED ({d.SQL_LIST})"
KNOWN_SQL = ("SELECT trim(token) AS token, arg_max(CASE WHEN label = '' THEN "
             "'KNOWLEDGE_BASE_MATCH' ELSE label END, ord) AS label FROM listed WHERE "
             "trim(token) <> '' GROUP BY 1")


@query("s4_knowledge_load", f"{LISTED} {KNOWN_SQL}")
def s4(spark, sf):
    return load_knowledge(d.list_entries(spark, sf))


@query("s5_keyword_load",
       f"{LISTED} SELECT label AS keyword, min(ord) AS ord FROM listed GROUP BY label")
def s5(spark, sf):
    return load_keywords(d.list_entries(spark, sf).select(F.col("label").alias("keyword"), "ord"))


WORDS = r"\b[A-Za-z0-9_.\-]{3,}\b"
#: A list of whole tokens from whole texts: those of a quarter of all checksums.
KNOWN = (f"kb AS MATERIALIZED (SELECT DISTINCT v AS token, 'LISTED' AS label FROM ({g.spans_of(WORDS)}) w "
         "WHERE substr(md5(v), 1, 1) IN ('0', '1', '2', '3'))")


def listed_words(spark, sf):
    """A knowledge base of whole tokens taken from the texts themselves."""
    words = d.corpus(spark, sf).select(F.explode(F.array_distinct(knowledge_tokens(F.col("text")))).alias("token"))
    return words.distinct().filter(F.substring(F.md5("token"), 1, 1).isin(*"0123")).withColumn(
        "label", F.lit("LISTED"))


@query("j1_knowledge_lookup",
       f"{CORPUS}, {KNOWN}, f AS ({g.spans_of(WORDS)}) SELECT doc_id, s, v AS value, label "
       "FROM f JOIN kb ON kb.token = f.v")
def j1(spark, sf):
    return knowledge_matches(d.corpus(spark, sf), listed_words(spark, sf), ["doc_id"]).select(
        "doc_id", F.col("start").alias("s"), "value", "label")


@query("j1_knowledge_spans",
       f"{CORPUS}, {KNOWN}, f AS ({g.spans_of(WORDS)}) SELECT doc_id, count(*) AS n_spans FROM f "
       "JOIN kb ON kb.token = f.v GROUP BY doc_id")
def j1_spans(spark, sf):
    matches = knowledge_matches(d.corpus(spark, sf), listed_words(spark, sf), ["doc_id"])
    return matches_as_spans(matches, ["doc_id"]).select(
        "doc_id", F.size("external").cast("bigint").alias("n_spans"))


BLOCKED = ("ProjectManhattan", "SecretCodenameX", "CLEAN prompt", "notes")


@query("j2_keyword_blacklist",
       f"{CORPUS} SELECT doc_id, array_to_string(list_filter(["
       + ", ".join(f"CASE WHEN contains(lower(text), '{k.lower()}') THEN '{k}' END"
                   for k in BLOCKED)
       + "], lambda x: x IS NOT NULL), ';') AS keywords FROM corpus")
def j2(spark, sf):
    return d.corpus(spark, sf).select("doc_id", joined(
        matched_keywords(F.col("text"), BLOCKED)).alias("keywords"))


@query("j2_keyword_table",
       f"{CORPUS}, f AS ({g.spans_of(WORDS)}), kw AS (SELECT DISTINCT p_name AS keyword FROM part UNION SELECT "
       "DISTINCT v FROM f WHERE substr(md5(v), 1, 2) IN ('00', '01')) SELECT doc_id, keyword FROM corpus JOIN kw ON "
       "contains(lower(text), lower(keyword))")
def j2_table(spark, sf):
    names = d.table(spark, sf, "part").select(F.col("p_name").alias("keyword"))
    words = d.corpus(spark, sf).select(F.explode(F.array_distinct(knowledge_tokens(F.col("text")))).alias("keyword"))
    words = words.filter(F.substring(F.md5("keyword"), 1, 2).isin("00", "01"))
    listed = cut_lineage(names.unionByName(words).distinct().withColumn("ord", F.lit(0)))
    return keyword_hits(d.corpus(spark, sf), listed, ["doc_id"]).select("doc_id", "keyword")


MODEL_KEPT = (f"m AS ({d.SQL_MODEL}), p AS (SELECT m.doc_id, m.start AS s, m.\"end\" AS e, "
              "upper(m.label) AS label, substr(c.text, m.start + 1, m.\"end\" - m.start) AS v "
              "FROM m JOIN corpus c ON c.doc_id = m.doc_id WHERE m.score >= 0.35 AND m.label <> "
              "'OTHER' AND m.start >= 0 AND m.\"end\" <= length(c.text))")
MODEL_TYPE = ("CASE label WHEN 'PERSON_NAME' THEN 'PHI_NAME' WHEN 'API_KEY' THEN 'SECRET_KEY' WHEN "
              "'CREDIT_CARD_NUMBER' THEN 'CREDIT_CARD' ELSE 'DB_CONNECTION_STRING' END")


OTHERS_OUT = " AND m.label <> 'OTHER'"
EVERY_TYPE = "CASE label WHEN 'OTHER' THEN 'PHI_NAME'"


@query("j3_model_spans",
       f"{CORPUS}, {MODEL_KEPT} SELECT doc_id, s, e, v AS value, {MODEL_TYPE} AS type FROM p")
def j3(spark, sf):
    df = ext.with_model_spans(d.corpus(spark, sf), d.model_spans(spark, sf), ["doc_id"],
                              labels=ext.MODEL_LABELS)
    return kept_rows(df, "external")


@query("j3_all_labels",
       f"{CORPUS}, {MODEL_KEPT.replace(OTHERS_OUT, '')} SELECT doc_id, s, e, v AS value, "
       f"{MODEL_TYPE.replace('CASE label', EVERY_TYPE)} AS type FROM p")
def j3_all(spark, sf):
    """Without a list of labels every prediction is kept; unknown labels are names."""
    df = ext.with_model_spans(d.corpus(spark, sf), d.model_spans(spark, sf), ["doc_id"])
    return kept_rows(df, "external")


@query("u3_model_labels",
       f"{CORPUS}, {MODEL_KEPT.replace('0.35', '0.22')} SELECT doc_id, s, e, v AS value, "
       f"{MODEL_TYPE} AS type FROM p WHERE label IN ('PERSON_NAME', 'API_KEY')")
def u3(spark, sf):
    df = ext.with_model_spans(d.corpus(spark, sf), d.model_spans(spark, sf), ["doc_id"],
                              threshold=ext.SERVICE_THRESHOLD,
                              labels=["person_name", "api_key"])
    return kept_rows(df, "external")


ENTITY_TABLE = ("m AS (SELECT doc_id, start AS s, \"end\" AS e, CASE WHEN label = 'person_name' "
                f"THEN 'PER' WHEN label = 'API_KEY' THEN 'ORG' ELSE 'LOC' END AS type FROM "
                f"({d.SQL_MODEL}) q WHERE start >= 0)")


def entity_table(spark, sf):
    m = d.model_spans(spark, sf).filter("start >= 0")
    type_ = (F.when(F.col("label") == "person_name", "PER")
             .when(F.col("label") == "API_KEY", "ORG").otherwise("LOC"))
    return m.select("doc_id", type_.alias("type"), "text", "start", "end",
                    F.lit(None).cast("double").alias("confidence"))


@query("j4_entities_as_spans",
       f"{CORPUS}, f AS MATERIALIZED ({g.rule_spans(CLIENT_RULES)}), {ENTITY_TABLE}, "
       f"a AS MATERIALIZED (SELECT * FROM f UNION ALL {g.entropy_spans('f')} UNION ALL SELECT "
       "m.doc_id, 990, row_number() OVER (PARTITION BY m.doc_id ORDER BY m.s), m.s, m.e, "
       "substr(c.text, m.s + 1, m.e - m.s), 'NER_' || m.type, CASE m.type WHEN 'PER' THEN "
       "'[PERSON_NAME_REDACTED]' WHEN 'LOC' THEN '[LOCATION_REDACTED]' ELSE "
       "'[ORGANIZATION_REDACTED]' END FROM m JOIN corpus c ON c.doc_id = m.doc_id), "
       f"k AS MATERIALIZED ({g.resolve('a', 'longest')}), o AS ({g.splice('corpus', 'k')}) "
       "SELECT doc_id, out AS sanitized_text FROM o")
def j4(spark, sf):
    df = ext.with_entity_table(d.corpus(spark, sf), entity_table(spark, sf), ["doc_id"])
    return client_scan(df, external=F.col("external")).select("doc_id", "sanitized_text")


MODEL_ENTITIES = (f"me AS (SELECT doc_id, k.s AS s, k.e + (k.s % 2) AS e, CASE WHEN k.s % 3 = 0 "
                  "THEN 'LOC' ELSE k.type END AS type FROM k WHERE k.s % 4 <> 0)")


@query("j5_drop_known_entities",
       f"{ENTITY_CTES}, {MODEL_ENTITIES} SELECT doc_id, k.type AS type, k.v AS value, k.s AS s "
       "FROM k WHERE NOT EXISTS (SELECT 1 FROM me WHERE me.doc_id = k.doc_id AND ((me.s = k.k.s "
       "AND me.e = k.k.e) OR (me.s <= k.k.s AND me.e >= k.k.e AND me.type = k.k.type)))")
def j5(spark, sf):
    found = cut_lineage(span_rows(with_entities(d.corpus(spark, sf)), ["doc_id"], "entities"))
    model = found.filter("start % 4 <> 0").select(
        "doc_id", "start", (F.col("end") + F.col("start") % 2).alias("end"),
        F.when(F.col("start") % 3 == 0, "LOC").otherwise(F.col("type")).alias("type"))
    return ent.drop_known(found, model, ["doc_id"]).select(
        "doc_id", "type", "value", F.col("start").alias("s"))


@query("j5_drop_known_in_row",
       f"{ENTITY_CTES}, {MODEL_ENTITIES} SELECT doc_id, count(*) AS n FROM k "
       "WHERE NOT EXISTS (SELECT 1 FROM me WHERE me.doc_id = k.doc_id AND ((me.s = k.k.s "
       "AND me.e = k.k.e) OR (me.s <= k.k.s AND me.e >= k.k.e AND me.type = k.k.type))) "
       "GROUP BY doc_id")
def j5_row(spark, sf):
    df = with_entities(d.corpus(spark, sf))
    model = F.transform(F.filter("entities", lambda e: e["start"] % 4 != 0), lambda e: F.struct(
        e["start"].alias("start"), (e["end"] + e["start"] % 2).alias("end"),
        F.when(e["start"] % 3 == 0, "LOC").otherwise(e["type"]).alias("type")))
    df = df.withColumn("model", model)
    left = F.size(drop_known_entities(F.col("entities"), F.col("model"))).cast("bigint")
    return df.select("doc_id", left.alias("n")).filter("n > 0")


FREE_ENTITIES = ("NOT EXISTS (SELECT 1 FROM ck WHERE ck.doc_id = en.doc_id AND en.k.s < ck.k.e AND "
                 "en.k.e > ck.k.s)")
BOTH = (f"{CLIENT_CTES.replace(', k AS MATERIALIZED', ', ck AS MATERIALIZED')}, "
        + ENTITY_CTES[len(CORPUS) + 2:].replace("a AS MATERIALIZED", "ea AS MATERIALIZED", 1)
        .replace("FROM a GROUP", "FROM ea GROUP"))


@query("j6_entities_off_rules",
       f"{BOTH} SELECT doc_id, en.k.type AS type, en.k.v AS value, en.k.s AS s FROM k en WHERE "
       f"{FREE_ENTITIES}")
def j6(spark, sf):
    df = cut_lineage(with_entities(with_client_spans(d.corpus(spark, sf))).select("doc_id", "spans", "entities"))
    entities = span_rows(df, ["doc_id"], "entities")
    spans = span_rows(df, ["doc_id"]).select("doc_id", "start", "end")
    return ent.drop_overlapping_rows(entities, spans, ["doc_id"]).select(
        "doc_id", "type", "value", F.col("start").alias("s"))


@query("a1_counts_per_type", f"{CLIENT_CTES} SELECT k.type AS type, count(*) AS n FROM k GROUP BY 1")
def a1(spark, sf):
    return redactions_per_type(with_client_spans(d.corpus(spark, sf)))


@query("a1_counts_per_document",
       f"{CLIENT_CTES} SELECT doc_id, k.type AS type, count(*) AS n FROM k GROUP BY 1, 2")
def a1_doc(spark, sf):
    df = client_scan(d.corpus(spark, sf))
    return df.select("doc_id", F.explode("redaction_counts").alias("type", "n"))


@query("a2_entity_classes",
       f"{ENTITY_CTES} SELECT count(*) FILTER (k.type = 'PER') AS \"PER\", count(*) FILTER "
       "(k.type = 'LOC') AS \"LOC\", count(*) FILTER (k.type = 'ORG') AS \"ORG\", count(*) FILTER "
       "(k.type = 'MISC') AS \"MISC\", count(*) AS total FROM k")
def a2(spark, sf):
    return ent.count_classes(span_rows(with_entities(d.corpus(spark, sf)), ["doc_id"],
                                       "entities"))


@query("a3_types_per_conversation",
       f"{CHAT} SELECT conv_id, coalesce(array_to_string(list_sort(list(DISTINCT k.k.type) FILTER "
       "(k.k.type IS NOT NULL)), ';'), '') AS pii_types FROM chat c LEFT JOIN k ON k.doc_id = c.doc_id "
       "GROUP BY conv_id")
def a3(spark, sf):
    return types_per_scope(scan_messages(d.chat(spark, sf)), ["conv_id"]).select(
        "conv_id", joined(F.col("pii_types")).alias("pii_types"))


@query("a4_values_per_conversation",
       f"{CHAT} SELECT conv_id, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_values FROM chat c LEFT "
       "JOIN (SELECT doc_id, count(DISTINCT k.v) AS n FROM k GROUP BY doc_id) v ON v.doc_id = "
       "c.doc_id GROUP BY conv_id")
def a4(spark, sf):
    return scan_messages(d.chat(spark, sf)).groupBy("conv_id").agg(
        F.sum("n_values").alias("n_values"))


@query("c1_client_pipeline",
       f"{CLIENT_CTES}, o AS ({g.splice('corpus', 'k')}), n AS (SELECT doc_id, "
       "string_agg(type || '=' || c, ';' ORDER BY type) AS counts, sum(c) AS total FROM (SELECT "
       "doc_id, k.type AS type, count(*) AS c FROM k GROUP BY 1, 2) q GROUP BY doc_id) SELECT "
       "o.doc_id, length(o.text) AS original_length, o.out AS sanitized_text, coalesce(n.counts, "
       "'') AS counts, CAST(coalesce(n.total, 0) AS INT) AS total_redacted FROM o LEFT JOIN n ON "
       "n.doc_id = o.doc_id")
def c1(spark, sf):
    counts = F.transform(F.map_entries("redaction_counts"), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string")))
    return client_scan(d.corpus(spark, sf)).select(
        "doc_id", "original_length", "sanitized_text", joined(counts).alias("counts"),
        "total_redacted")


@query("c2_gateway_pipeline",
       f"{GATEWAY}, {numbered(PREFIX_SQL)}, o AS ({g.splice('corpus', 'z')}), "
       f"y AS ({g.types_sql('k')}), mt AS (SELECT doc_id, string_agg(concat_ws('|', k.type, k.label, k.v, k.s, k.e), "
       "';' ORDER BY k.s) AS matches FROM z GROUP BY doc_id), tm AS (SELECT doc_id, string_agg(ph || '=' || v, ';' "
       "ORDER BY ph) AS tokens FROM t GROUP BY doc_id) SELECT o.doc_id, o.out AS sanitized_text, coalesce(y.types, '') "
       "AS types, coalesce(y.n_values, 0) AS n_values, coalesce(y.n_spans, 0) AS n_spans, coalesce(mt.matches, '') AS "
       "matches, coalesce(tm.tokens, '') AS tokens FROM o LEFT JOIN y ON y.doc_id = o.doc_id LEFT JOIN mt ON "
       "mt.doc_id = o.doc_id LEFT JOIN tm ON tm.doc_id = o.doc_id")
def c2(spark, sf):
    return gateway_scan(d.corpus(spark, sf)).select(
        "doc_id", "sanitized_text", joined("pii_types").alias("types"),
        F.col("n_values").cast("bigint").alias("n_values"),
        F.col("n_spans").cast("bigint").alias("n_spans"),
        joined(F.transform("matches", lambda m: F.concat_ws(
            "|", m["type"], m["placeholder"], m["value"], m["start"].cast("string"), m["end"].cast("string"))))
        .alias("matches"),
        joined(F.array_sort(F.transform(F.map_entries("token_map"), lambda e: F.concat(
            e["key"], F.lit("="), e["value"])))).alias("tokens"))


LISTED_FOUND = gateway_found().replace(gateway_found().split(" UNION ALL ")[0], (
    "SELECT f.doc_id, -1 AS ord, f.i, f.s, f.e, f.v, 'KNOWLEDGE_BASE_MATCH' AS type, '' AS label "
    "FROM f JOIN kb ON kb.token = f.v"), 1)


@query("c2_table_list",
       f"{CORPUS}, f AS MATERIALIZED ({g.spans_of(WORDS)}), kb AS MATERIALIZED (SELECT DISTINCT v AS token FROM f WHERE "
       f"substr(md5(v), 1, 2) IN ('00', '01', '02')), a AS MATERIALIZED ({LISTED_FOUND}), k AS MATERIALIZED "
       f"({g.resolve('a', 'leftmost')}), {numbered(PREFIX_SQL)}, o AS ({g.splice('corpus', 'z')}) "
       "SELECT doc_id, out AS sanitized_text FROM o")
def c2_table(spark, sf):
    """The gateway with a knowledge list that is a table: whole tokens of the texts."""
    listed = listed_words(spark, sf).filter(F.substring(F.md5("token"), 1, 2).isin("00", "01", "02"))
    return gateway_scan(d.corpus(spark, sf), knowledge=cut_lineage(listed), key=["doc_id"]).select(
        "doc_id", "sanitized_text")


@query("c2_with_model_spans",
       f"{CORPUS}, {MODEL_KEPT}, a AS MATERIALIZED ({gateway_found()} UNION ALL SELECT doc_id, "
       f"5000, 1, s, e, v, {MODEL_TYPE}, '' FROM p), k AS MATERIALIZED "
       f"({g.resolve('a', 'leftmost')}), {numbered(PREFIX_SQL)}, o AS ({g.splice('corpus', 'z')}) "
       "SELECT doc_id, out AS sanitized_text FROM o")
def c2_model(spark, sf):
    df = ext.with_model_spans(d.corpus(spark, sf), d.model_spans(spark, sf), ["doc_id"],
                              labels=ext.MODEL_LABELS)
    return gateway_scan(df, external=F.col("external")).select("doc_id", "sanitized_text")


@query("c3_combined",
       f"{BOTH.replace(', ck AS MATERIALIZED', ', ck_unused AS')}, all_spans AS MATERIALIZED "
       "(SELECT doc_id, ord, i, s, e, v, type, label FROM a UNION ALL SELECT doc_id, 990, "
       "row_number() OVER (PARTITION BY doc_id ORDER BY k.s), k.s, k.e, k.v, 'NER_' || k.type, CASE "
       "k.type WHEN 'PER' THEN '[PERSON_NAME_REDACTED]' WHEN 'LOC' THEN '[LOCATION_REDACTED]' ELSE "
       "'[ORGANIZATION_REDACTED]' END FROM k), fin AS MATERIALIZED "
       f"({g.resolve('all_spans', 'longest')}), o AS ({g.splice('corpus', 'fin')}) "
       "SELECT doc_id, out AS sanitized_text FROM o")
def c3(spark, sf):
    return combined_scan(d.corpus(spark, sf)).select("doc_id", "sanitized_text")


C4_ROWS = (f"SELECT q.doc_id, c.session, q.k.s AS s, q.k.e AS e, q.k.v AS v, q.k.type AS type FROM "
           f"(SELECT doc_id, k FROM ck UNION ALL SELECT en.doc_id, en.k FROM k en WHERE {FREE_ENTITIES}) q "
           "JOIN corpus c ON c.doc_id = q.doc_id")


@query("c4_interceptor",
       f"{BOTH}, {session_ctes(C4_ROWS, KIND_SQL)}, {SESSION_KEPT}, "
       f"o AS ({g.splice('corpus', 'sk')}), n AS (SELECT doc_id, count(*) AS n FROM sk GROUP BY "
       "doc_id) SELECT o.doc_id, o.out AS sanitized_text, coalesce(n.n, 0) AS redacted_count, "
       "coalesce(n.n, 0) = 0 OR o.out <> o.text AS is_safe FROM o LEFT JOIN n ON n.doc_id = o.doc_id")
def c4(spark, sf):
    out, _ = intercept(d.corpus(spark, sf), ["doc_id"], ["session"], "doc_id")
    return out.select("doc_id", "sanitized_text",
                      F.col("redacted_count").cast("bigint").alias("redacted_count"), "is_safe")


SECRET = "Exposed live infrastructure secret or API key"
INJECTED = "Potential LLM prompt injection or jailbreak attempt detected"
PHRASES = ("ignore previous instructions", "system prompt override", "jailbreak",
           "reveal confidential system key", "override security rules", "bypass guardrails",
           "act as an unrestricted ai")


def injected_sql(text):
    return "(" + " OR ".join(f"contains(lower({text}), '{p}')" for p in PHRASES) + ")"


def threat_sql(exposed: str, injected: str, any_type: str) -> dict[str, str]:
    """score, level, action and reasons as SQL over two flags and one more."""
    return {
        "score": f"CAST(CASE WHEN {exposed} AND {injected} THEN 1.0 WHEN {injected} THEN 0.6 "
                 f"WHEN {exposed} THEN 0.5 ELSE 0.0 END AS DOUBLE)",
        "level": f"CASE WHEN {exposed} AND {injected} THEN 'CRITICAL' WHEN {injected} OR {exposed} "
                 "THEN 'HIGH' ELSE 'LOW' END",
        "action": f"CASE WHEN {exposed} AND {injected} THEN 'QUARANTINED' WHEN {injected} OR "
                  f"{exposed} THEN 'BLOCKED' ELSE 'FORWARDED' END",
        "reasons": f"CASE WHEN {exposed} AND {injected} THEN '{SECRET};{INJECTED}' WHEN {injected} "
                   f"THEN '{INJECTED}' WHEN {exposed} THEN '{SECRET}' WHEN {any_type} THEN "
                   "'Standard PII sanitized locally' ELSE 'Clean prompt' END",
    }


FACTS = ("x AS MATERIALIZED (SELECT c.doc_id, c.text, coalesce(bool_or(k.k.type IN ('SECRET_KEY', "
         "'API_KEY', 'DB_CONNECTION_STRING')), false) AS exposed, count(k.doc_id) > 0 AS has_any, "
         f"{injected_sql('c.text')} AS injected, coalesce(string_agg(DISTINCT k.k.type, ';' ORDER "
         "BY k.k.type), '') AS types, count(DISTINCT k.k.v) AS n_values FROM corpus c LEFT JOIN k "
         "ON k.doc_id = c.doc_id GROUP BY c.doc_id, c.text)")
T = threat_sql("exposed", "injected", "has_any")


@query("c5_threat",
       f"{GATEWAY}, {FACTS} SELECT doc_id, {T['score']} AS score, {T['level']} AS risk_level, "
       f"{T['action']} AS action, {T['reasons']} AS reasons FROM x")
def c5(spark, sf):
    from veilframe.operators.spans import has_injection
    from veilframe.operators.threat import threat

    df = gateway_scan(d.corpus(spark, sf))
    t = threat(has_injection(F.col("text")), F.col("pii_types"))
    return df.withColumn("t", t).select(
        "doc_id", "t.score", "t.risk_level", "t.action", joined(F.col("t.reasons"))
        .alias("reasons"))


CHAT_FACTS = (
    "m1 AS MATERIALIZED (SELECT c.doc_id, c.conv_id, c.role, c.text, count(DISTINCT k.k.v) AS nv, "
    "count(k.doc_id) AS ns FROM chat c LEFT JOIN k ON k.doc_id = c.doc_id GROUP BY ALL), "
    "ty AS (SELECT conv_id, list_sort(list(DISTINCT k.k.type)) AS types FROM k JOIN chat c ON "
    "c.doc_id = k.doc_id GROUP BY conv_id), "
    "g1 AS MATERIALIZED (SELECT m1.conv_id, count(*) AS n_messages, bool_or(role = 'user' AND "
    f"{injected_sql('text')}) AS injected, bool_or(role = 'user' AND contains(lower(text), "
    "'projectmanhattan')) AS blocked, CAST(sum(nv) AS BIGINT) AS nv, CAST(sum(ns) AS BIGINT) AS ns, "
    "any_value(coalesce(ty.types, [])) AS types FROM m1 LEFT JOIN ty ON ty.conv_id = m1.conv_id "
    "GROUP BY m1.conv_id), "
    "g2 AS MATERIALIZED (SELECT *, len(list_filter(types, lambda q: q IN ('SECRET_KEY', "
    "'DB_CONNECTION_STRING'))) > 0 AS exposed, len(types) > 0 AS has_any FROM g1)")
DECISION = (
    f"SELECT conv_id, n_messages, ns AS n_spans, CASE WHEN blocked THEN 'BLOCKED' ELSE "
    f"{T['action']} END AS action, CASE WHEN NOT blocked THEN {T['level']} END AS risk_level, "
    f"CASE WHEN NOT blocked THEN {T['score']} END AS risk_score, CASE WHEN NOT blocked THEN "
    f"{T['reasons']} END AS reasons, CASE WHEN blocked THEN 'CONFIDENTIAL_BLACK_KEYWORD' WHEN "
    f"exposed OR injected THEN array_to_string(list_concat(types, ['THREAT_' || {T['level']}]), ';')"
    " ELSE array_to_string(types, ';') END AS types, CASE WHEN blocked THEN 0 ELSE nv END AS "
    "tokens_redacted_count FROM g2")


@query("c6_conversation_decision", f"{CHAT}, {CHAT_FACTS} {DECISION}")
def c6(spark, sf):
    return decide(scan_messages(d.chat(spark, sf))).select(
        "conv_id", "n_messages", "n_spans", "action", "risk_level", "risk_score",
        joined("reasons").alias("reasons"), joined("pii_types_detected").alias("types"),
        "tokens_redacted_count")


CHAT_KEPT = ("sk AS MATERIALIZED (SELECT w.doc_id, struct_pack(s := w.s, e := w.e, label := m.ph) AS "
             "k FROM w JOIN m ON m.conv_id = w.conv_id AND m.v = w.v)")
PROMPTS_OUT = (f"o AS ({g.splice('corpus', 'sk')}), pr AS (SELECT c.conv_id, string_agg(o.out, "
               "chr(10) ORDER BY c.turn) AS prompt FROM o JOIN chat c ON c.doc_id = o.doc_id WHERE "
               "c.role = 'user' GROUP BY c.conv_id)")


@query("c6_audit_records",
       f"{CHAT}, {CHAT_TOKENS}, {CHAT_KEPT}, {PROMPTS_OUT}, {CHAT_FACTS}, de AS ({DECISION}) SELECT "
       "de.conv_id, de.action, de.types, de.tokens_redacted_count, CASE WHEN risk_level IS NULL "
       "THEN '[BLOCKED BY CONFIDENTIAL BLACKLIST KEYWORD: ProjectManhattan] ' || prompt WHEN action "
       "<> 'FORWARDED' THEN '[BLOCKED BY THREAT ENGINE: ' || replace(reasons, ';', ', ') || '] ' || "
       "prompt ELSE coalesce(prompt, '[Pre-Sanitized Client Prompt]') END AS sanitized_prompt FROM "
       "de LEFT JOIN pr ON pr.conv_id = de.conv_id")
def c6_audit(spark, sf):
    scanned = cut_lineage(scan_messages(d.chat(spark, sf)))
    sanitized, _ = number_messages(scanned)
    prompts = joined_prompts(sanitized, text="sanitized_text")
    return audit_records(decide(scanned), prompts).select(
        "conv_id", "action", joined("pii_types_detected").alias("types"),
        "tokens_redacted_count", "sanitized_prompt")


@query("c6_late_turns", CHECKS["c6_audit_records"])
def c6_late(spark, sf):
    """The same conversations with turn numbers from 5,000 on: one record each, as before."""
    late = d.chat(spark, sf).withColumn("turn", F.col("turn") + 5000)
    scanned = cut_lineage(scan_messages(late))
    sanitized, _ = number_messages(scanned)
    return audit_records(decide(scanned), joined_prompts(sanitized, text="sanitized_text")).select(
        "conv_id", "action", joined("pii_types_detected").alias("types"),
        "tokens_redacted_count", "sanitized_prompt")


@query("c6_message_numbering",
       f"{CHAT}, {numbered(PREFIX_SQL)}, o AS ({g.splice('corpus', 'z')}) SELECT c.conv_id, c.turn, "
       "o.out AS sanitized_text FROM o JOIN chat c ON c.doc_id = o.doc_id")
def c6_each(spark, sf):
    return number_each_message(scan_messages(d.chat(spark, sf))).select(
        "conv_id", "turn", "sanitized_text")


@query("c7_zero_knowledge",
       f"{CHAT}, {CHAT_FACTS} SELECT conv_id, CASE WHEN blocked THEN 'BLOCKED' WHEN conv_id % 2 = 0 "
       f"THEN CASE WHEN injected THEN 'BLOCKED' ELSE 'FORWARDED' END ELSE {T['action']} END AS "
       "action, CASE WHEN blocked THEN 'CONFIDENTIAL_BLACK_KEYWORD' WHEN conv_id % 2 = 0 THEN CASE "
       "WHEN injected THEN 'CLIENT_SIDE_ENCRYPTED;THREAT_HIGH' ELSE 'CLIENT_SIDE_ENCRYPTED' END "
       f"WHEN exposed OR injected THEN array_to_string(list_concat(types, ['THREAT_' || "
       f"{T['level']}]), ';') ELSE array_to_string(types, ';') END AS types, CASE WHEN blocked THEN "
       "0 WHEN conv_id % 2 = 0 THEN CASE WHEN injected THEN 0 ELSE 1 END ELSE nv END AS "
       "tokens_redacted_count FROM g2")
def c7(spark, sf):
    scanned = scan_messages(d.chat(spark, sf))
    return decide(scanned, zero_knowledge=F.col("conv_id") % 2 == 0).select(
        "conv_id", "action", joined("pii_types_detected").alias("types"),
        "tokens_redacted_count")


@query("c6_end_to_end",
       f"SELECT *, concat('model-', conv_id % 3) AS upstream_model FROM ({CHECKS['c7_zero_knowledge']}) q")
def c6_whole(spark, sf):
    """Request bodies to messages, decisions with the body's own flag, and full ledger records.

    The records are appended to a ledger and read back from it.
    """
    message = F.struct("turn", "role", F.col("text").alias("content"))
    bodies = d.chat(spark, sf).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(message)).alias("m")).select("conv_id", F.to_json(F.struct(
            F.concat(F.lit("model-"), F.col("conv_id") % 3).alias("model"),
            (F.col("conv_id") % 2 == 0).alias("zeroKnowledgeMode"),
            F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
            .alias("messages"))).alias("body"))
    bodies = cut_lineage(bodies)
    options = chat_options(bodies)
    messages = explode_chat(bodies).join(options.select("conv_id", "zero_knowledge"), "conv_id")
    scanned = cut_lineage(scan_messages(messages))
    sanitized, _ = number_messages(scanned)
    records = audit_records(decide(scanned, zero_knowledge=F.col("zero_knowledge")),
                            joined_prompts(sanitized, text="sanitized_text"))
    path = shared_folder(spark)
    append_audit(ledger_records(records, options), path)
    written = spark.read.parquet(path)
    return records.select("conv_id", F.md5(F.concat_ws(":", F.lit("audit"), F.col("conv_id").cast("string")))
                          .alias("id"), "action").join(written, "id").select(
        "conv_id", "action", joined("pii_types_detected").alias("types"),
        F.col("tokens_redacted_count").cast("bigint").alias("tokens_redacted_count"), "upstream_model")


@query("c8_image_text_gate",
       "WITH corpus AS MATERIALIZED (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM "
       f"({d.SQL_CORPUS} UNION ALL SELECT -1 - c_custkey, '', '  ' FROM customer) q), {gateway_ctes()}, {FACTS}, b AS (SELECT *, contains(lower(text), "
       "'projectmanhattan') AS blocked FROM x) SELECT doc_id, CASE WHEN text = '' THEN "
       f"'NO_TEXT_DETECTED' WHEN blocked THEN 'BLOCKED' WHEN exposed OR injected THEN {T['action']} "
       "WHEN has_any THEN 'REDACTED_AND_STRUCTURED' ELSE 'CLEAN_DOCUMENT' END AS action, CASE WHEN "
       "text = '' THEN '' WHEN blocked THEN 'CONFIDENTIAL_BLACK_KEYWORD;OCR_DOCUMENT' WHEN exposed "
       f"OR injected THEN ltrim(types || ';OCR_THREAT_' || {T['level']}, ';') WHEN has_any THEN types "
       "|| ';OCR_DOCUMENT' ELSE 'OCR_DOCUMENT' END AS types, CASE WHEN text = '' OR blocked THEN 0 "
       "ELSE n_values END AS tokens_redacted_count FROM b")
def c8(spark, sf):
    """All texts, and images in which no text was found: one for each customer."""
    blank = d.table(spark, sf, "customer").select((-1 - F.col("c_custkey")).alias("doc_id"), F.lit("").alias("session"),
                                                  F.lit("  ").alias("text"))
    df = d.corpus(spark, sf).unionByName(blank)
    return image_text_gate(df).select(
        "doc_id", "action", joined("pii_types_detected").alias("types"),
        F.col("tokens_redacted_count").cast("bigint").alias("tokens_redacted_count"))


@query("u2_custom_entity_labels",
       f"{ENTITY_CTES}, z AS (SELECT doc_id, struct_pack(s := k.s, e := k.e, label := '<' || "
       f"lower(k.type) || '>') AS k FROM k), o AS ({g.splice('corpus', 'z')}) "
       "SELECT doc_id, out AS sanitized_text FROM o")
def u2(spark, sf):
    df, view, _ = add_view(d.corpus(spark, sf), "text", ENTITY_RULES)
    from veilframe.operators.overlap import longest_first

    df = df.withColumn("entities", longest_first(entity_spans(view, ENTITY_RULES)))
    return df.select("doc_id", redact_entities(
        F.col("text"), F.col("entities"),
        {"PER": "<per>", "LOC": "<loc>", "ORG": "<org>"}).alias("sanitized_text"))

