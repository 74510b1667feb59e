"""Queries on rules, entities, entropy and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite import data as d, sqlgen as g
from suite.registry import query
from veilframe.columns import pinned
from veilframe.functions import (
    checksums as ck, entropy as en, labels as lb, language as lg, quality as ql,
)
from veilframe.operators.redact import repair_ocr_digits
from veilframe.operators.spans import (
    client_entropy_spans, find_spans, gateway_entropy_spans, has_injection,
)
from veilframe.operators.tokens import span_rows
from veilframe.plans.client import with_client_spans, with_entities
from veilframe.plans.gateway import SEED_KNOWLEDGE, with_gateway_spans
from veilframe.rules import (
    CLIENT_RULES, ENTITY_RULES, ENTROPY_RULE, GATEWAY_RULES, gateway_rules, rules_frame,
    select_rules,
)
from veilframe.rules.local import BARE_JWT, LOOSE_SK
from veilframe.rules.model import add_view

CORPUS = f"WITH corpus AS MATERIALIZED ({d.SQL_CORPUS})"


def joined(array):
    return F.array_join(array, ";")


def raw_rows(df, rules, keep=("doc_id",)):
    """Every checked match, before overlaps are resolved."""
    df, view, _ = add_view(df, "text", rules)
    df = df.withColumn("spans", pinned(find_spans(view, rules)))
    return span_rows(df, list(keep)).select(
        *keep, "type", "value", F.col("start").alias("s"), F.col("end").alias("e"))


def flat(rules, ctes=CORPUS):
    return (f"{ctes}, f AS ({g.rule_spans(rules)}) "
            "SELECT doc_id, type, v AS value, s, e FROM f")


@query("p1_client_spans", flat(CLIENT_RULES))
def p1_client(spark, sf):
    return raw_rows(d.corpus(spark, sf), CLIENT_RULES)


@query("p1_gateway_spans", flat(GATEWAY_RULES))
def p1_gateway(spark, sf):
    return raw_rows(d.corpus(spark, sf), GATEWAY_RULES)


@query("p1_local_spans", flat((BARE_JWT, LOOSE_SK)))
def p1_local(spark, sf):
    return raw_rows(d.corpus(spark, sf), (BARE_JWT, LOOSE_SK))


PAGE_TEXT = "WITH corpus AS MATERIALIZED (SELECT page_id AS doc_id, html AS text FROM pages)"


@query("p1_page_counts",
       f"{PAGE_TEXT}, f AS ({g.rule_spans(CLIENT_RULES)}) "
       "SELECT type, count(*) AS n, count(DISTINCT v) AS n_values FROM f GROUP BY type")
def p1_pages(spark, sf):
    pages = d.table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"),
                                               F.col("html").alias("text"))
    return raw_rows(pages, CLIENT_RULES).groupBy("type").agg(
        F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


# PER_ANCHOR and the other anchors end in their group, so the gap trick gives its offset.
ENTITY_CTES = (f"{CORPUS}, a AS MATERIALIZED ({g.rule_spans(ENTITY_RULES, min_length=2)}), "
               f"k AS MATERIALIZED ({g.resolve('a', 'longest')})")


@query("p2_entity_spans",
       f"{ENTITY_CTES} SELECT doc_id, k.type AS type, k.v AS value, k.s AS s, k.e AS e FROM k")
def p2(spark, sf):
    return span_rows(with_entities(d.corpus(spark, sf)), ["doc_id"], "entities").select(
        "doc_id", "type", "value", F.col("start").alias("s"), F.col("end").alias("e"))


PHRASES = ("ignore previous instructions", "system prompt override", "jailbreak",
           "reveal confidential system key", "override security rules", "bypass guardrails",
           "act as an unrestricted ai")


@query("p3_injection",
       f"{CORPUS} SELECT doc_id, ("
       + " OR ".join(f"contains(lower(text), '{p}')" for p in PHRASES)
       + ") AS injection FROM corpus")
def p3(spark, sf):
    return d.corpus(spark, sf).select("doc_id", has_injection(F.col("text")).alias("injection"))


def gateway_found(profile="BALANCED", honour=False):
    base, standard = gateway_rules(profile, honour)
    words = ", ".join(g.quote(w) for w in SEED_KNOWLEDGE)
    known = g.spans_of(r"\b[A-Za-z0-9_.\-]{3,}\b",
                       "(SELECT * FROM corpus WHERE "
                       + " OR ".join(f"contains(text, {g.quote(w)})" for w in SEED_KNOWLEDGE)
                       + ")", keep=f"v IN ({words})")
    parts = [f"SELECT doc_id, -1 AS ord, i, s, e, v, 'KNOWLEDGE_BASE_MATCH' AS type, '' AS label "
             f"FROM ({known}) kb", g.rule_spans(base), g.entropy_spans(None)]
    if standard:
        parts.append(f"SELECT * REPLACE (ord + 1000 AS ord) FROM ({g.rule_spans(standard)}) st")
    return " UNION ALL ".join(parts)


def gateway_ctes(profile="BALANCED", honour=False):
    return (f"a AS MATERIALIZED ({gateway_found(profile, honour)}), "
            f"k AS MATERIALIZED ({g.resolve('a', 'leftmost')})")


def _profile_query(profile, honour, name):
    sql = (f"{CORPUS}, {gateway_ctes(profile, honour)} "
           "SELECT k.type AS type, count(*) AS n, count(DISTINCT doc_id) AS n_docs "
           "FROM k GROUP BY 1")

    @query(name, sql)
    def run(spark, sf):
        df = with_gateway_spans(d.corpus(spark, sf), profile=profile, honour_profiles=honour)
        return span_rows(df, ["doc_id"]).groupBy("type").agg(
            F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))
    return run


_profile_query("STRICT", False, "p4_strict_profile")
_profile_query("PERMISSIVE", False, "p4_permissive_profile")
_profile_query("PERMISSIVE", True, "p4_permissive_honoured")
_profile_query("BALANCED", True, "p4_balanced_honoured")

P5_RULES = select_rules(CLIENT_RULES, risks={"CRITICAL"}, min_confidence=99.9)


@query("p5_rule_selection",
       f"{CORPUS}, f AS ({g.rule_spans(P5_RULES)}), c(type, category) AS (VALUES "
       + ", ".join(f"('{r.id}', '{r.category}')" for r in P5_RULES)
       + ") SELECT category, count(*) AS n FROM f JOIN c USING (type) GROUP BY category")
def p5(spark, sf):
    catalogue = rules_frame(spark, P5_RULES).select("type", "category")
    rows = raw_rows(d.corpus(spark, sf), P5_RULES).groupBy("type").agg(F.count("*").alias("n"))
    return rows.join(catalogue, "type").groupBy("category").agg(F.sum("n").alias("n"))


CLIENT_CTES = (
    f"{CORPUS}, f AS MATERIALIZED ({g.rule_spans(CLIENT_RULES)}), "
    f"a AS MATERIALIZED (SELECT * FROM f UNION ALL {g.entropy_spans('f')}), "
    f"k AS MATERIALIZED ({g.resolve('a', 'longest')})")


@query("p6_client_entropy_spans",
       f"{CORPUS}, f AS MATERIALIZED ({g.rule_spans(CLIENT_RULES)}), "
       f"t AS ({g.entropy_spans('f')}) SELECT doc_id, v AS value, s, "
       f"round({g.entropy_sql('v')}, 3) AS entropy FROM t")
def p6_client(spark, sf):
    df, view, _ = add_view(d.corpus(spark, sf), "text", (*CLIENT_RULES, ENTROPY_RULE))
    df = df.withColumn("found", find_spans(view, CLIENT_RULES))
    df = df.withColumn("spans", client_entropy_spans(view, F.col("found")))
    return span_rows(df, ["doc_id"]).select("doc_id", "value", F.col("start").alias("s"),
                                            "entropy")


@query("p6_gateway_entropy_spans",
       f"{CORPUS}, t AS ({g.entropy_spans(None)}) SELECT doc_id, v AS value, s, "
       f"round({g.entropy_sql('v')}, 6) AS entropy FROM t")
def p6_gateway(spark, sf):
    df, view, _ = add_view(d.corpus(spark, sf), "text", (ENTROPY_RULE,))
    df = df.withColumn("spans", gateway_entropy_spans(view))
    return span_rows(df, ["doc_id"]).select("doc_id", "value", F.col("start").alias("s"),
                                            F.round("entropy", 6).alias("entropy"))


NUMBERS = f"WITH n AS ({d.SQL_NUMBERS})"


@query("f1_entropy",
       f"{NUMBERS} SELECT k, token, round({g.entropy_sql('token')}, 3) AS entropy FROM n")
def f1(spark, sf):
    return d.numbers(spark, sf).select("k", "token",
                                       en.shannon_entropy(F.col("token"), 3).alias("entropy"))


@query("f2_high_entropy",
       f"{NUMBERS}, e AS (SELECT k, token, {g.entropy_sql('token')} AS h, length(token) >= 16 "
       "AND regexp_matches(token, '[a-z]') AND regexp_matches(token, '[0-9]') AS shape FROM n) "
       "SELECT k, token, shape AND round(h, 3) >= 3.7 AS client, shape AND h > 3.8 AS gateway, "
       "shape AND h > 3.7 AS extension FROM e")
def f2(spark, sf):
    """Three thresholds on one entropy, which is worked out once for each token."""
    t, bits = F.col("token"), F.col("bits")
    rows = d.numbers(spark, sf).select("k", "token", pinned(F.when(en.secret_shape(t), en.shannon_entropy(t))).alias("bits"))
    return rows.select(
        "k", "token", en.reaches(bits).alias("client"),
        en.reaches(bits, 3.8, strict=True, digits=None).alias("gateway"),
        en.reaches(bits, 3.7, strict=True, digits=None).alias("extension"))


@query("f3_luhn", f"{NUMBERS} SELECT k, card, {g.luhn_sql('card')} AS valid FROM n")
def f3(spark, sf):
    return d.numbers(spark, sf).select("k", "card", ck.luhn_valid(F.col("card")).alias("valid"))


@query("f4_lenient_card",
       f"{NUMBERS} SELECT k, card, {g.luhn_sql('card')} OR length(card) IN (15, 16) AS valid "
       "FROM n")
def f4(spark, sf):
    return d.numbers(spark, sf).select("k", "card",
                                       ck.lenient_card(F.col("card")).alias("valid"))


@query("f5_verhoeff",
       f"{NUMBERS} SELECT k, identity, {g.verhoeff_sql('identity')} AS valid FROM n")
def f5(spark, sf):
    return d.numbers(spark, sf).select(
        "k", "identity", ck.verhoeff_valid(F.col("identity")).alias("valid"))


@query("f6_verhoeff_digit",
       f"{NUMBERS} SELECT k, identity, CAST([0, 4, 3, 2, 1, 5, 6, 7, 8, 9]"
       f"[{g.verhoeff_fold_sql('identity', 1)} + 1] AS INT) AS digit FROM n")
def f6(spark, sf):
    return d.numbers(spark, sf).select(
        "k", "identity", ck.verhoeff_check_digit(F.col("identity")).alias("digit"))


MAIL = select_rules(CLIENT_RULES, ids={"EMAIL"})
NEAR = ("again", "contact")
AROUND = "lower(substr(text, greatest(0, s - 50) + 1, e + 50 - greatest(0, s - 50)))"


@query("f7_proximity",
       f"{CORPUS}, f AS ({g.spans_of(g.re2(MAIL[0]))}) SELECT doc_id, s, ("
       + " OR ".join(f"contains({AROUND}, '{k}')" for k in NEAR) + ") AS near FROM f")
def f7(spark, sf):
    df, view, _ = add_view(d.corpus(spark, sf), "text", MAIL)
    df = df.withColumn("spans", find_spans(view, MAIL))
    near = F.transform("spans", lambda s: F.struct(s["start"].alias("s"), ql.near_keyword(
        F.col("text"), s["start"], s["end"] - s["start"], NEAR).alias("near")))
    return df.select("doc_id", F.explode_outer(near).alias("n")).filter(
        F.col("n").isNotNull()).select("doc_id", "n.s", "n.near")


ROMAN = (r"'(?i)\b(karo|kare|karte|waqt|ho|gaya|hai|raha|naam|mera|apna|tapaasa|zhala|ahe|"
         r"krupaya)\b'")
ROMAN_MR = r"'(?i)\b(zhala|ahe|krupaya|tapaasa|mhnun)\b'"
LANGUAGE_SQL = (
    "CASE WHEN regexp_matches(text, '[ऀ-ॿ]') THEN CASE WHEN regexp_matches(text, "
    "'[ळिीआहेतहाहोतेखातरलॉगिन]') AND regexp_matches(text, "
    "'(?i)(आहे|नाही|झाला|केला|tapaasa|zhala)') THEN 'mr' ELSE 'hi' END "
    f"WHEN regexp_matches(text, {ROMAN}) THEN CASE WHEN regexp_matches(text, {ROMAN_MR}) "
    "THEN 'mr' ELSE 'hi' END ELSE 'en' END")


@query("f8_language", f"{CORPUS} SELECT doc_id, {LANGUAGE_SQL} AS language, CASE WHEN "
       f"session IN ('en', 'hi', 'mr') THEN session WHEN doc_id % 9 = 0 THEN 'mr' ELSE "
       f"{LANGUAGE_SQL} END AS chosen FROM corpus")
def f8(spark, sf):
    choice = F.when(F.col("doc_id") % 9 == 0, "mr").otherwise(F.col("session"))
    return d.corpus(spark, sf).select(
        "doc_id", lg.guess_language(F.col("text")).alias("language"),
        lg.guess_language(F.col("text"), choice).alias("chosen"))


@query("f9_script", f"{CORPUS} SELECT doc_id, CASE WHEN regexp_matches(text, '[ऀ-ॿ]') THEN 'hi' "
       "ELSE 'en' END AS script FROM corpus")
def f9(spark, sf):
    return d.corpus(spark, sf).select("doc_id", lg.script_language(F.col("text")).alias("script"))


def _instruction_case(texts):
    return ("CASE language " + " ".join(f"WHEN '{k}' THEN {g.quote(v)}"
                                        for k, v in texts.items()) + " END")


@query("f10_instruction",
       f"{CORPUS}, l AS (SELECT doc_id, {LANGUAGE_SQL} AS language FROM corpus) SELECT doc_id, "
       f"language, {_instruction_case(lg.GATEWAY_INSTRUCTIONS)} AS language_instruction, "
       f"{_instruction_case(lg.SERVER_INSTRUCTIONS)} AS server_instruction FROM l")
def f10(spark, sf):
    df = d.corpus(spark, sf).select(
        "doc_id", lg.guess_language(F.col("text")).alias("language"))
    return lg.with_instruction(lg.with_instruction(df), wording="server",
                               out="server_instruction")


@query("f11_model_label",
       f"WITH m AS ({d.SQL_MODEL}) SELECT doc_id, label, CASE "
       "WHEN contains(upper(label), 'SSN') OR contains(upper(label), 'SOCIAL_SECURITY') THEN 'SSN' "
       "WHEN contains(upper(label), 'CREDIT') OR contains(upper(label), 'CARD') THEN 'CREDIT_CARD' "
       "WHEN contains(upper(label), 'SECRET') OR contains(upper(label), 'KEY') OR "
       "contains(upper(label), 'TOKEN') THEN 'SECRET_KEY' "
       "WHEN contains(upper(label), 'EMAIL') THEN 'EMAIL' "
       "WHEN contains(upper(label), 'PHONE') THEN 'PHONE' "
       "WHEN contains(upper(label), 'DB') OR contains(upper(label), 'CONNECTION') OR "
       "contains(upper(label), 'CREDENTIAL') THEN 'DB_CONNECTION_STRING' ELSE 'PHI_NAME' END "
       "AS type FROM m")
def f11(spark, sf):
    return d.model_spans(spark, sf).select("doc_id", "label",
                                           lb.type_of_model_label(F.col("label")).alias("type"))


PREFIX_SQL = ("CASE {t} WHEN 'SSN' THEN 'SSN' WHEN 'CREDIT_CARD' THEN 'CARD' WHEN 'SECRET_KEY' "
              "THEN 'SECRET_KEY' WHEN 'HIGH_ENTROPY_SECRET' THEN 'SECRET_KEY' WHEN "
              "'KNOWLEDGE_BASE_MATCH' THEN 'ASSET' WHEN 'EMAIL' THEN 'EMAIL' WHEN 'PHONE' THEN "
              "'PHONE' WHEN 'DB_CONNECTION_STRING' THEN 'DB_CONN' WHEN 'PHI_NAME' THEN 'NAME' "
              "ELSE 'PII' END")
KIND_SQL = ("CASE {t} WHEN 'CARD_NUMBER' THEN 'CREDIT_CARD' WHEN 'PER' THEN 'PERSON' WHEN 'LOC' "
            "THEN 'LOCATION' WHEN 'ORG' THEN 'ORGANIZATION' ELSE {t} END")


@query("f12_token_prefix",
       f"{CORPUS}, f AS ({g.rule_spans(GATEWAY_RULES)}) SELECT type, "
       f"{PREFIX_SQL.format(t='type')} AS prefix, count(*) AS n FROM f GROUP BY 1, 2")
def f12(spark, sf):
    return raw_rows(d.corpus(spark, sf), GATEWAY_RULES).groupBy(
        "type", lb.token_prefix(F.col("type")).alias("prefix")).agg(F.count("*").alias("n"))


@query("f13_ledger_type",
       f"WITH t AS ({d.SQL_TAGS}), u AS (SELECT doc_id, pos, upper(regexp_replace(regexp_replace("
       "'NER_' || substr(entity, 3), '^NER_', ''), '[\\s\\-]+', '_', 'g')) AS x FROM t) "
       f"SELECT doc_id, pos, {KIND_SQL.format(t='x')} AS kind FROM u UNION ALL "
       "SELECT p_partkey, p_size, upper(regexp_replace(p_type, '[\\s\\-]+', '_', 'g')) FROM part")
def f13(spark, sf):
    tags = d.tags(spark, sf).select("doc_id", "pos", lb.ledger_type(F.concat(
        F.lit("ner_"), F.substring("entity", 3, 9))).alias("kind"))
    parts = d.table(spark, sf, "part").select(
        F.col("p_partkey").alias("doc_id"), F.col("p_size").alias("pos"),
        lb.ledger_type(F.col("p_type")).alias("kind"))
    return tags.unionByName(parts)


BLOCK = "[0-9OlI]{4}"
OCR_RE = rf"\b{BLOCK}[\s\-]{BLOCK}[\s\-]{BLOCK}[\s\-]{BLOCK}\b"


@query("f14_ocr_digits",
       f"{CORPUS}, f AS ({g.spans_of(OCR_RE)}), k AS (SELECT doc_id, struct_pack(s := s, e := e, "
       "label := regexp_replace(translate(v, 'OoIl', '0011'), '[\\s\\-]', ' ', 'g')) AS k FROM f), "
       f"o AS ({g.splice('corpus', 'k')}) SELECT doc_id, out AS repaired FROM o")
def f14(spark, sf):
    return d.corpus(spark, sf).select("doc_id",
                                      repair_ocr_digits(F.col("text")).alias("repaired"))


HOST = ("concat(CASE page_id % 7 WHEN 0 THEN 'chatgpt.com/' WHEN 1 THEN 'claude.ai/' WHEN 2 THEN "
        "'gemini.google.com/' WHEN 3 THEN 'www.perplexity.ai/' WHEN 4 THEN 'chat.deepseek.com/' "
        "WHEN 5 THEN 'platform.openai.com/' ELSE 'example.org/' END, url)")


@query("f15_platform",
       f"WITH h AS (SELECT page_id, {HOST} AS host FROM pages) SELECT page_id, CASE WHEN "
       "contains(host, 'openai') OR contains(host, 'chatgpt') THEN 'ChatGPT' WHEN "
       "contains(host, 'claude') THEN 'Claude' WHEN contains(host, 'google') OR "
       "contains(host, 'gemini') THEN 'Gemini' WHEN contains(host, 'perplexity') THEN 'Perplexity' "
       "WHEN contains(host, 'deepseek') THEN 'DeepSeek' ELSE 'Custom AI' END AS platform FROM h")
def f15(spark, sf):
    return d.table(spark, sf, "pages").select(
        "page_id", lg.platform_of(F.expr(HOST)).alias("platform"))


MARKED = ("concat(sanitized_prompt, ' & [REDACTED_PERSON_2] <b> [SSN_REDACTED_1][EMAIL_REDACTED] ', "
          "'Bearer [JWT_TOKEN_REDACTED]')")
MARK_RE = (r"(\[[A-Z0-9_]+_REDACTED\]|\[REDACTED_[A-Z0-9_]+\]|Bearer \[TOKEN_REDACTED\]|"
           r"Bearer \[JWT_TOKEN_REDACTED\])")


@query("f17_placeholders",
       f"WITH a AS ({d.SQL_AUDIT}), b AS (SELECT id, {MARKED} AS t FROM a) SELECT id, "
       "CAST(len(regexp_extract_all(t, '\\[REDACTED_[A-Z0-9_]+\\]')) AS INT) AS n_ledger, "
       "array_to_string(regexp_extract_all(t, '\\[[A-Z_]+_REDACTED_\\d+\\]'), ';') AS numbered, "
       "regexp_replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
       f"{g.quote(MARK_RE)}, '<mark>\\1</mark>', 'g') AS marked, "
       "CAST(2 * len(regexp_extract_all(t, '\\[[A-Z_]+_REDACTED_\\d+\\]')) + 1 AS INT) AS n_pieces "
       "FROM b")
def f17(spark, sf):
    t = F.expr(MARKED)
    return d.audit(spark, sf).select(
        "id", lb.count_placeholders(t).alias("n_ledger"),
        joined(lb.extract_placeholders(t)).alias("numbered"),
        lb.mark_placeholders(t).alias("marked"),
        F.size(lb.split_on_placeholders(t)).alias("n_pieces"))


RISK_LIST = ", ".join(f"('{r.id}', '{r.risk}')" for r in (*CLIENT_RULES, ENTROPY_RULE))


@query("f18_receipt_risk",
       f"{CLIENT_CTES}, r(type, risk) AS (VALUES {RISK_LIST}), x AS (SELECT doc_id, count(*) AS n, "
       "bool_or(r.risk = 'CRITICAL') AS c FROM k JOIN r ON r.type = k.type GROUP BY doc_id) "
       "SELECT c.doc_id, CASE WHEN coalesce(x.c, false) THEN 'CRITICAL' ELSE 'HIGH' END AS "
       "risk_level, CAST(least(100, coalesce(x.n, 0) * 22 + 45) AS INT) AS risk_score "
       "FROM corpus c LEFT JOIN x ON x.doc_id = c.doc_id")
def f18(spark, sf):
    df = with_client_spans(d.corpus(spark, sf))
    return df.select(
        "doc_id", ql.receipt_risk_level(F.transform("spans", lambda s: s["risk"]))
        .alias("risk_level"), ql.receipt_risk_score(F.size("spans")).alias("risk_score"))


@query("f19_payload_gate",
       f"{CORPUS}, p AS (SELECT doc_id, CAST(strlen(CAST(to_json(struct_pack(doc_id := doc_id, "
       "text := text)) AS VARCHAR)) AS INT) AS bytes FROM corpus) SELECT doc_id, bytes, "
       "bytes <= 2048 AS receipt_ok, bytes <= 65536 AS request_ok FROM p")
def f19(spark, sf):
    n = ql.payload_bytes("doc_id", "text")
    return d.corpus(spark, sf).select("doc_id", n.alias("bytes")).select(
        "doc_id", "bytes", (F.col("bytes") <= ql.RECEIPT_LIMIT_BYTES).alias("receipt_ok"),
        (F.col("bytes") <= ql.REQUEST_LIMIT_BYTES).alias("request_ok"))


@query("f20_offsets",
       f"{CLIENT_CTES} SELECT c.doc_id, count(k.doc_id) AS n_spans, "
       "coalesce(bool_and(substr(c.text, k.k.s + 1, k.k.e - k.k.s) = k.k.v), true) AS holds "
       "FROM corpus c LEFT JOIN k ON k.doc_id = c.doc_id GROUP BY c.doc_id")
def f20(spark, sf):
    df = with_client_spans(d.corpus(spark, sf))
    return df.select("doc_id", F.size("spans").cast("bigint").alias("n_spans"),
                     ql.offsets_hold(F.col("text"), F.col("spans")).alias("holds"))


@query("f21_entity_names",
       f"WITH t AS ({d.SQL_TAGS}), u AS (SELECT doc_id, pos, substr(entity, 3) AS type FROM t) "
       "SELECT doc_id, pos, CASE type WHEN 'PER' THEN 'PERSON' WHEN 'LOC' THEN 'LOCATION' "
       "ELSE 'ORGANIZATION' END AS name, CASE type WHEN 'PER' THEN 'HIGH' ELSE 'MEDIUM' END "
       "AS risk FROM u")
def f21(spark, sf):
    t = F.substring("entity", 3, 9)
    return d.tags(spark, sf).select("doc_id", "pos", lb.entity_name(t).alias("name"),
                                    lb.entity_risk(t).alias("risk"))
