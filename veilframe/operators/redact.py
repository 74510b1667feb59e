"""Replacing spans in a row's text: fixed labels and per-document numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from veilframe.columns import in_blocks, let, pinned
from veilframe.functions.entropy import is_high_entropy
from veilframe.functions.labels import entity_label, token_prefix
from veilframe.operators.spans import find_spans, locate
from veilframe.rules.client import ENTROPY_RULE
from veilframe.rules.local import fallback_rules
from veilframe.rules.model import SIGNALS, TextView, java_regex


def splice(text: Column, spans: Column, label: Callable[[Column], Column]) -> Column:
    """Text with each span replaced; spans must be in text order and must not overlap.

    The text is cut once for a block of spans and then inside the cut, since Spark counts
    characters from the start. Text and spans are bound first: Spark may put the expressions
    behind them into the lambda, where they would be computed again for every span.
    """
    def build(both):
        text, ss = both["text"], both["spans"]

        def block(part, base):
            """The text from ``base`` to the end of the block's last span, replaced."""
            def pieces(cut):
                edges = F.concat(F.array(base), F.transform(part, lambda s: s["end"]))
                return F.array_join(F.zip_with(part, F.slice(edges, F.lit(1), F.size(part)), lambda s, edge: F.concat(
                    F.substring(cut, edge - base + 1, s["start"] - edge), label(s))), "")
            return let(F.substring(text, base + 1, F.get(part, F.size(part) - 1)["end"] - base), pieces)

        def whole(parts):
            done = F.transform(parts, lambda part, i: let(
                F.when(i == 0, 0).otherwise(F.element_at(F.get(parts, i - 1), -1)["end"]),
                lambda base: block(part, base)))
            return F.concat(F.array_join(done, ""), F.substring(
                text, F.element_at(ss, -1)["end"] + 1, F.length(text)))
        return let(in_blocks(ss), whole)
    return let(F.struct(text.alias("text"), spans.alias("spans")), lambda both: F.when(
        F.size(both["spans"]) == 0, both["text"]).otherwise(build(both)))


def redact_with_labels(text: Column, spans: Column) -> Column:
    """Every span becomes its own fixed label."""
    return splice(text, spans, lambda s: s["label"])


def redact_entities(text: Column, entities: Column,
                    custom_labels: dict[str, str] | None = None) -> Column:
    return splice(text, entities, lambda s: entity_label(s["type"], custom_labels))


def token_map(spans: Column, prefix: Callable[[Column], Column] = token_prefix,
              by_type: bool = False) -> Column:
    """map<value, placeholder> of one document, numbered from the right end of the text.

    Equal values share a placeholder. Counters run per placeholder prefix, so two types
    with one prefix never get the same placeholder and the map can be turned round;
    ``by_type`` counts per type instead.
    """
    def build(ss):
        named = F.transform(F.reverse(ss), lambda s: F.struct(
            s["value"].alias("value"), prefix(s["type"]).alias("prefix"),
            (s["type"] if by_type else prefix(s["type"])).alias("counter")))

        def distinct(ns):
            # Equal spans are one; only if a value has several types is its first place looked up.
            def first_of(us):
                values = F.transform(us, lambda n: n["value"])
                return let(values, lambda vs: F.when(
                    F.size(F.array_distinct(vs)) == F.size(vs), us).otherwise(F.filter(
                        us, lambda n, i: F.array_position(vs, n["value"]) == i + 1)))
            return let(F.array_distinct(ns), first_of)

        def numbered(us):
            counters = F.array_distinct(F.transform(us, lambda u: u["counter"]))
            entries = F.transform(counters, lambda c: F.transform(
                F.filter(us, lambda u: u["counter"] == c),
                lambda u, i: F.struct(u["value"].alias("key"), F.concat(
                    F.lit("["), u["prefix"], F.lit("_REDACTED_"), (i + 1).cast("string"),
                    F.lit("]")).alias("value"))))
            return F.map_from_entries(F.flatten(entries))
        return let(let(named, distinct), numbered)
    return let(spans, build)


def redact_with_tokens(text: Column, spans: Column, tokens: Column) -> Column:
    """Every span becomes the placeholder of its value."""
    return let(tokens, lambda t: splice(text, spans, lambda s: t[s["value"]]))


def placeholder_map(tokens: Column) -> Column:
    """map<placeholder, value> from map<value, placeholder>."""
    return F.map_from_arrays(F.map_values(tokens), F.map_keys(tokens))


def sequential_counter(df, text: str, stages, out: str = "sanitized"):
    """Apply rules one after the other, each on the output of the one before.

    One counter runs over all stages. Adds ``out`` (text), ``items`` (type, original,
    placeholder, explanation) and ``n_items``.
    """
    current = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn(out, current).withColumn("n_items", F.lit(0)).withColumn(
        "items", F.array().cast(
            "array<struct<type:string,original:string,placeholder:string,explanation:string>>"))
    for stage in stages:
        rule, prefix, type_ = stage[:3]
        explanation = stage[3] if len(stage) > 3 else None
        now = F.col(out)
        df = df.withColumn("_lowered", F.lower(now) if rule.fold_case else now)
        view = TextView(now, F.col("_lowered"))
        spans = find_spans(view, (rule,))
        found = F.transform(spans, lambda s, i: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
            F.concat(F.lit(f"[{prefix}_REDACTED_"),
                     (F.col("n_items") + i + 1).cast("string"), F.lit("]")).alias("label")))
        # Null where the gate is shut: most texts pass most stages by, without an array.
        gate = rule.may_match(view)
        df = df.withColumn("_found", pinned(found if gate is None else F.when(gate, found)))
        hit = F.size("_found") > 0
        items = F.transform(F.col("_found"), lambda s: F.struct(
            F.lit(type_).alias("type"), s["value"].alias("original"),
            s["label"].alias("placeholder"), F.lit(explanation).cast("string")
            .alias("explanation")))
        df = df.select(
            *[c for c in df.columns if c not in (out, "n_items", "items", "_found", "_lowered")],
            F.when(hit, splice(now, F.col("_found"), lambda s: s["label"])).otherwise(now).alias(out),
            (F.col("n_items") + F.when(hit, F.size("_found")).otherwise(0)).alias("n_items"),
            F.when(hit, F.concat(F.col("items"), items)).otherwise(F.col("items")).alias("items"))
    return df


def items_token_map(items: Column) -> Column:
    return F.map_from_entries(F.transform(items, lambda i: F.struct(
        i["placeholder"].alias("key"), i["original"].alias("value"))))


def redact_fallback(df, text: str, out: str = "sanitized", count: str = "n_redacted"):
    """Static labels by chained replacement, then the first high-entropy token.

    Cards need 13 to 19 digits but no checksum; the entropy step replaces one token.
    """
    df = df.withColumn(out, F.coalesce(F.col(text), F.lit(""))).withColumn(count, F.lit(0))
    keep = [c for c in df.columns if c not in (out, count)]
    for rule in fallback_rules():
        now = F.col(out)
        condition = rule.may_match(TextView(now, F.lower(now)))
        hit = F.lit(True) if condition is None else condition
        df = df.select(
            *keep,
            F.when(hit, F.regexp_replace(
                now, rule.regex, rule.label.replace("$", r"\$"))).otherwise(now).alias(out),
            (F.col(count) + F.when(hit, F.regexp_count(now, F.lit(rule.regex)))
             .otherwise(0)).alias(count))
    now = F.col(out)
    # The token alone is needed, not its place: what is replaced is where it stands first.
    secret = F.get(F.filter(F.regexp_extract_all(now, F.lit(ENTROPY_RULE.regex), F.lit(0)), lambda v: is_high_entropy(v, 3.7, strict=True, digits=None)), F.lit(0))
    df = df.withColumn("_secret", pinned(F.when(
        now.rlike(SIGNALS["long"]) & ~now.contains("[HIGH_ENTROPY_REDACTED]"), secret)))
    at = F.instr(now, F.col("_secret"))
    return df.select(
        *keep,
        F.when(F.col("_secret").isNull(), now).otherwise(F.concat(
            F.substring(now, F.lit(1), at - 1), F.lit("[HIGH_ENTROPY_REDACTED]"),
            F.substring(now, at + F.length("_secret"), F.length(now)))).alias(out),
        (F.col(count) + F.col("_secret").isNotNull().cast("int")).alias(count))


def repair_ocr_digits(text: Column) -> Column:
    """In 4x4 digit blocks read O as 0, I and l as 1, and put single blanks between."""
    block = "[0-9OlI]{4}"
    core = rf"{block}[\s\-]{block}[\s\-]{block}[\s\-]{block}"
    def fixed(s):
        return F.regexp_replace(F.translate(s["value"], "OoIl", "0011"), r"[\s\-]", " ")
    return let(text, lambda t: F.when(
        t.rlike(core), let(locate(t, java_regex(core, "word", "word")),
                           lambda ss: splice(t, ss, fixed))).otherwise(t))
