"""The gateway pipeline: spans, leftmost resolution, numbered placeholders per document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from veilframe.columns import let, literal_map, pinned, text_or_empty
from veilframe.functions.labels import token_prefix
from veilframe.functions.language import guess_language, with_instruction
from veilframe.operators.knowledge import with_knowledge
from veilframe.operators.matching import rule_hits
from veilframe.operators.overlap import leftmost
from veilframe.operators.redact import placeholder_map, redact_with_tokens, token_map
from veilframe.operators.spans import find_spans, hit_spans, knowledge_rule, knowledge_words
from veilframe.rules.client import ENTROPY_RULE
from veilframe.rules.gateway import BALANCED, gateway_rules
from veilframe.rules.model import add_view
from veilframe.rules.local import LEFTMOST_PERSONAL, LEFTMOST_SECRETS

# Fixed value: bits of a character above which a token is a secret.
GATEWAY_ENTROPY = 3.8
# The seed list of the knowledge base.
SEED_KNOWLEDGE = {
    "PROJECT_HYDRA": "CONFIDENTIAL_PROJECT_CODENAME",
    "PROJECT_MANHATTAN": "CONFIDENTIAL_PROJECT_CODENAME",
    "SECRET_CODENAME_X": "CONFIDENTIAL_PROJECT_CODENAME",
    "CORP_VAULT_KEY_2026": "KNOWLEDGE_BASE_MATCH",
}


def with_gateway_spans(df: DataFrame, text: str = "text", profile: str = BALANCED,
                       knowledge: dict[str, str] | DataFrame | None = None,
                       external: Column | None = None, honour_profiles: bool = False,
                       out: str = "spans", key: Sequence[str] = ()) -> DataFrame:
    """Add the resolved gateway spans of each row.

    No shuffle, but for a knowledge list that is a table (token, label): its tokens meet the texts' own in a
    join, for which ``key`` must name a text.
    """
    listed = "_knowledge"
    if isinstance(knowledge, DataFrame):
        if not key:
            raise ValueError("a knowledge table needs the columns that name a text")
        df = with_knowledge(df, knowledge, key, text, listed)
    base, standard = gateway_rules(profile, honour_profiles)
    # The standard group repeats patterns of the base list without adding a span that
    # survives, unless the profile took the base rule away: it only costs a second pass.
    present = {(r.core, r.left, r.right, r.span_type) for r in base}
    standard = tuple(r for r in standard
                     if (r.core, r.left, r.right, r.span_type) not in present)
    words = {} if isinstance(knowledge, DataFrame) else SEED_KNOWLEDGE if knowledge is None else knowledge
    tokens = knowledge_words(words)
    # In detector order: the list, the patterns, entropy, the standard group.
    rules = ((knowledge_rule(tokens),) if tokens else ()) + base
    entropy = len(rules)
    body = text_or_empty(text)
    df = df.withColumn("_hits", rule_hits(body, (*rules, ENTROPY_RULE, *standard), {0: tokens} if tokens else None,
                                          {entropy: GATEWAY_ENTROPY}))
    sources = [(r, ["SHANNON_ENTROPY"] if i == entropy else r.methods,
                "KNOWLEDGE_BASE" if tokens and i == 0 else "ENTROPY" if i == entropy else "DETERMINISTIC")
               for i, r in enumerate((*rules, ENTROPY_RULE, *standard))]
    alone = hit_spans(F.filter("_hits", lambda h: h["free"]), sources)
    others = []
    if isinstance(knowledge, DataFrame):
        others.append(F.col(listed))
    if external is not None:
        df = df.withColumn("_external", external)
        others.append(F.filter("_external", lambda s: (s["start"] >= 0) & (s["end"] > s["start"])
                               & (s["end"] <= F.length(body))))
    found = alone
    if others:
        before, behind = (others[:1], others[1:]) if isinstance(knowledge, DataFrame) else ([], others)
        met = leftmost(F.concat(*before, hit_spans(F.col("_hits"), sources), *behind))
        found = F.when(sum((F.coalesce(F.size(o), F.lit(0)) for o in others), F.lit(0)) > 0, met).otherwise(alone)
    df = df.withColumn(out, pinned(found))
    return df.drop("_hits", *([listed] if isinstance(knowledge, DataFrame) else []), *(["_external"] if external is not None else []))


def _tokenise(df: DataFrame, text: str, prefix=token_prefix) -> DataFrame:
    body = text_or_empty(text)
    df = df.withColumn("_tokens", pinned(token_map(F.col("spans"), prefix)))
    return (df
            .withColumn("sanitized_text",
                        redact_with_tokens(body, F.col("spans"), F.col("_tokens")))
            .withColumn("token_map", placeholder_map(F.col("_tokens")))
            .withColumn("matches", let(F.col("_tokens"), lambda t: F.transform(
                "spans", lambda s: F.struct(
                    s["type"].alias("type"), t[s["value"]].alias("placeholder"),
                    s["value"].alias("value"), s["start"].alias("start"),
                    s["end"].alias("end")))))
            .withColumn("pii_types", F.array_sort(F.array_distinct(
                F.transform("spans", lambda s: s["type"]))))
            .withColumn("n_values", F.size("_tokens"))
            .withColumn("n_spans", F.size("spans"))
            .drop("_tokens"))


def gateway_scan(df: DataFrame, text: str = "text", profile: str = BALANCED,
                 knowledge: dict[str, str] | DataFrame | None = None, external: Column | None = None,
                 language_override: Column | None = None, honour_profiles: bool = False,
                 instruction: bool = False, key: Sequence[str] = ()) -> DataFrame:
    """Sanitised text, token map, matches, types and language of each row.

    A knowledge list may be a table (token, label); ``key`` then names a text.
    """
    df = with_gateway_spans(df, text, profile, knowledge, external, honour_profiles, key=key)
    df = _tokenise(df, text).withColumn(
        "language", guess_language(text_or_empty(text), language_override))
    return with_instruction(df) if instruction else df


# This sanitiser's own prefixes; any other type is its own prefix.
LEFTMOST_PREFIXES = {"CREDIT_CARD": "CARD", "DB_CONNECTION_STRING": "DB_CONN",
                     "PHI_NAME": "NAME"}


def leftmost_scan(df: DataFrame, text: str = "text", profile: str = BALANCED) -> DataFrame:
    """The smaller client-side sanitiser: leftmost start wins, numbered placeholders."""
    rules = LEFTMOST_SECRETS + (LEFTMOST_PERSONAL if profile != "PERMISSIVE" else ())
    df, view, added = add_view(df, text, rules)
    found = pinned(leftmost(find_spans(view, rules), longest=False))
    df = df.withColumn("spans", found).drop(*added)
    return _tokenise(df, text, lambda t: F.coalesce(literal_map(LEFTMOST_PREFIXES)[t], t))
