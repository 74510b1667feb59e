"""Finding spans: every match of every rule, with code-point offsets, in one projection."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F

from veilframe.columns import any_of, fold_in_blocks, let, trim_blank
from veilframe.functions.checksums import VALIDATORS
from veilframe.functions.entropy import secret_shape, shannon_entropy
from veilframe.functions.quality import window_around
from veilframe.rules.client import ENTROPY_RULE
from veilframe.rules.gateway import KNOWLEDGE_TOKEN
from veilframe.rules.model import SIGNALS, Rule, TextView, java_regex

PLACE = "array<struct<start:int,end:int,value:string>>"
SPANS = ("array<struct<start:int,end:int,type:string,value:string,label:string,"
         "confidence:double,risk:string,methods:array<string>,entropy:double,source:string>>")


CATALOGUE = ("array<struct<type:string,label:string,confidence:double,risk:string,"
             "methods:array<string>,check:string,near:array<string>,source:string>>")


def no_spans() -> Column:
    return F.array().cast(SPANS)


def offsets(hits: Column, gaps: Column) -> Column:
    """(start, end, value) of every match, from the matches and the gaps between them."""
    steps = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.struct(
        F.length(g).alias("gap"), F.length(h).alias("len"), h.alias("value")))

    def place(at, s):
        start = at + s["gap"]
        return F.struct(start.alias("start"), (start + s["len"]).alias("end"),
                        s["value"].alias("value"))
    return fold_in_blocks(steps, F.lit(0), lambda at, s: at + s["gap"] + s["len"], place,
                          F.array().cast(PLACE))


def _inner(place: Column, part: Column) -> Column:
    """The group that stands at the end of a match, without blanks around it."""
    lead = F.length(part) - F.length(F.regexp_replace(part, r"^\s+", ""))
    start = place["end"] - F.length(part) + lead
    value = trim_blank(part)
    return F.struct(start.alias("start"), (start + F.length(value)).alias("end"),
                    value.alias("value"))


def locate(text: Column, regex: str) -> Column:
    """All matches of one pattern as (start, end, value), left to right.

    ``regexp_extract_all`` gives the matches and ``split`` the gaps between them; one
    fold over both turns lengths into offsets. The pattern must not match empty text.
    """
    hits = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    return let(hits, lambda h: F.when(F.size(h) > 0, offsets(h, F.split(text, regex, -1)))
               .otherwise(F.array().cast(PLACE)))


def _catalogue(rules) -> Column:
    """Fixed attributes of (rule, methods, source) as one constant array, indexed by rule."""
    rows = [{"type": r.span_type, "label": r.label, "confidence": float(r.confidence),
             "risk": r.risk, "methods": list(methods), "check": r.check,
             "near": [k.lower() for k in r.near], "source": source} for r, methods, source in rules]
    return F.from_json(F.lit(json.dumps(rows)), CATALOGUE)


def hit_spans(hits: Column, rules) -> Column:
    """Spans of the hits of :func:`veilframe.operators.matching.rule_hits`; ``rules`` are (rule, methods, source)."""
    def span(h):
        info = F.get(_catalogue(rules), h["rule"])
        return F.struct(
            h["start"].alias("start"), h["end"].alias("end"), info["type"].alias("type"),
            h["value"].alias("value"), info["label"].alias("label"), info["confidence"].alias("confidence"),
            info["risk"].alias("risk"), info["methods"].alias("methods"), h["entropy"].alias("entropy"),
            info["source"].alias("source"))
    return F.transform(hits, span)


def _matches(view: TextView, rule: Rule, index: int) -> Column:
    """Matches and gaps of one rule, or null where its gate is shut or nothing matches.

    The text is gone through for gaps and groups only if there are matches.
    """
    pattern = F.lit(rule.regex)
    found = let(F.regexp_extract_all(view.text, pattern, F.lit(0)), lambda hits: F.when(F.size(hits) > 0, F.struct(
        F.lit(index).alias("rule"), hits.alias("hits"),
        F.split(view.text, rule.regex, -1).alias("gaps"),
        (F.regexp_extract_all(view.text, pattern, F.lit(rule.span_group)) if rule.span_group
         else F.lit(None).cast("array<string>")).alias("parts"))))
    condition = rule.may_match(view)
    return found if condition is None else F.when(condition, found)


def find_spans(view: TextView, rules, source: str = "DETERMINISTIC",
               min_length: int = 1) -> Column:
    """Spans of all rules, in rule order and then text order; overlaps remain.

    Each rule contributes only its matches and gaps; offsets, checksums and proximity
    are worked out by one shared expression over the few rules that matched, so the
    plan stays small however long the catalogue is.
    """
    rules = tuple(rules)
    if not rules:
        return no_spans()
    matched = F.filter(F.array(*[_matches(view, r, i) for i, r in enumerate(rules)]),
                       lambda m: m.isNotNull())
    checks = sorted({r.check for r in rules if r.check})

    def spans_of(m, known):
        info = F.get(known, m["rule"])
        places = offsets(m["hits"], m["gaps"])
        if any(r.span_group for r in rules):
            places = F.when(m["parts"].isNull(), places).otherwise(
                F.zip_with(places, m["parts"], _inner))
        if min_length > 1:
            places = F.filter(places, lambda p: F.length(p["value"]) >= min_length)
        if checks:
            def valid(p):
                tested = F.when(info["check"] == "", F.lit(True))
                for name in checks:
                    tested = tested.when(info["check"] == name, VALIDATORS[name](p["value"]))
                return tested.otherwise(F.lit(True))
            places = F.filter(places, valid)
        if any(r.near for r in rules):
            places = F.filter(places, lambda p: (F.size(info["near"]) == 0) | let(
                window_around(view.text, p["start"], p["end"]),
                lambda around: F.exists(info["near"], lambda k: around.contains(k))))
        return F.transform(places, lambda p: F.struct(
            p["start"].alias("start"), p["end"].alias("end"), info["type"].alias("type"),
            p["value"].alias("value"), info["label"].alias("label"),
            info["confidence"].alias("confidence"), info["risk"].alias("risk"),
            info["methods"].alias("methods"), F.lit(None).cast("double").alias("entropy"),
            info["source"].alias("source")))
    return F.flatten(F.transform(matched, lambda m: spans_of(m, _catalogue([(r, r.methods, source) for r in rules]))))


def entropy_spans(view: TextView, free, threshold: float, strict: bool,
                  digits: int | None) -> Column:
    """High-entropy tokens; the entropy of a token is worked out once."""
    rule = ENTROPY_RULE
    candidates = F.filter(locate(view.text, rule.regex),
                          lambda p: secret_shape(p["value"]) & free(p))
    measured = F.transform(candidates, lambda p: F.struct(
        p["start"].alias("start"), p["end"].alias("end"), F.lit(rule.id).alias("type"),
        p["value"].alias("value"), F.lit(rule.label).alias("label"),
        F.lit(rule.confidence).alias("confidence"), F.lit(rule.risk).alias("risk"),
        F.array(F.lit("SHANNON_ENTROPY")).alias("methods"),
        shannon_entropy(p["value"], digits).alias("entropy"),
        F.lit("ENTROPY").alias("source")))
    found = F.filter(measured, lambda s: (
        s["entropy"] > threshold if strict else s["entropy"] >= threshold))
    return F.when(view.signals.get("long", view.text.rlike(SIGNALS["long"])), found
                  ).otherwise(no_spans())


def client_entropy_spans(view: TextView, found: Column) -> Column:
    """High-entropy tokens that do not start inside a span already found."""
    return let(found, lambda known: entropy_spans(
        view, lambda p: ~F.exists(known, lambda s: (
            (p["start"] >= s["start"]) & (p["start"] < s["end"]))), 3.7, False, 3))


def gateway_entropy_spans(view: TextView, threshold: float = 3.8) -> Column:
    return entropy_spans(view, lambda p: F.lit(True), threshold, True, None)


def entity_spans(view: TextView, rules) -> Column:
    """Contextual person, place and organisation spans of two or more characters."""
    return find_spans(view, rules, "CONTEXT", min_length=2)


def knowledge_tokens(text: Column) -> Column:
    """The tokens alone, in text order, with repeats."""
    return F.regexp_extract_all(text, F.lit(java_regex(KNOWLEDGE_TOKEN, "edge", "edge")), F.lit(0))


def knowledge_token_places(text: Column) -> Column:
    """Tokens of three or more characters, the unit of the knowledge-base lookup."""
    return locate(text, java_regex(KNOWLEDGE_TOKEN, "edge", "edge"))


def knowledge_words(entries: Iterable[str]) -> list[str]:
    """The entries of a list that can be tokens."""
    return [t.strip() for t in entries if len(t.strip()) >= 3]


def knowledge_rule(tokens: Sequence[str]) -> Rule:
    """The rule whose matches are tokens; those of ``tokens`` among them are hits."""
    return Rule("KNOWLEDGE_BASE_MATCH", KNOWLEDGE_TOKEN, "edge", "edge",
                label="[ASSET_REDACTED]", any_literal=tuple(tokens))


def knowledge_spans_from_map(view: TextView, entries: dict[str, str]) -> Column:
    """Knowledge-base hits for a short list held in the plan itself.

    For a list kept as a table use :func:`veilframe.operators.knowledge.knowledge_matches`.
    """
    tokens = knowledge_words(entries)
    if not tokens:
        return no_spans()
    rule = knowledge_rule(tokens)
    return F.filter(find_spans(view, (rule,), "KNOWLEDGE_BASE"),
                    lambda s: s["value"].isin(*tokens))


def has_injection(text: Column) -> Column:
    """Does the text hold one of the seven injection or jailbreak phrases?"""
    return any_of(text.rlike("(?i)" + p) for p in INJECTION_PHRASES)


# Fixed values.
INJECTION_PHRASES = (
    "ignore previous instructions", "system prompt override", "jailbreak",
    "reveal confidential system key", "override security rules", "bypass guardrails",
    "act as an unrestricted ai",
)
