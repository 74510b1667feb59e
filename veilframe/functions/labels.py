"""Names of types, prefixes, entity classes, and the placeholders made of them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from veilframe.columns import literal_map

# Fixed values.
PREFIX_OF_TYPE = {
    "SSN": "SSN", "CREDIT_CARD": "CARD", "SECRET_KEY": "SECRET_KEY",
    "HIGH_ENTROPY_SECRET": "SECRET_KEY", "KNOWLEDGE_BASE_MATCH": "ASSET", "EMAIL": "EMAIL",
    "PHONE": "PHONE", "DB_CONNECTION_STRING": "DB_CONN", "PHI_NAME": "NAME",
}
LEDGER_RENAMES = {"CARD_NUMBER": "CREDIT_CARD", "PER": "PERSON", "LOC": "LOCATION",
                  "ORG": "ORGANIZATION"}
ENTITY_NAMES = {"PER": "PERSON", "LOC": "LOCATION", "ORG": "ORGANIZATION",
                "MISC": "MISCELLANEOUS"}
ENTITY_LABELS = {"PER": "[PERSON_NAME_REDACTED]", "LOC": "[LOCATION_REDACTED]",
                 "ORG": "[ORGANIZATION_REDACTED]", "MISC": "[ENTITY_REDACTED]"}

NUMBERED = r"\[[A-Z_]+_REDACTED_\d+\]"
LEDGER_STYLE = r"\[REDACTED_[A-Z0-9_]+\]"
ANY_MARK = (r"\[[A-Z0-9_]+_REDACTED\]|\[REDACTED_[A-Z0-9_]+\]|Bearer \[TOKEN_REDACTED\]|"
            r"Bearer \[JWT_TOKEN_REDACTED\]")
ANY_PLACEHOLDER = r"\[[A-Z_]+_REDACTED_\d+\]|\[REDACTED_[A-Z0-9_]+_\d+\]"


def type_of_model_label(label: Column) -> Column:
    """Type of a model's entity label, by substring."""
    name = F.upper(label)

    def has(*parts):
        found = name.contains(parts[0])
        for p in parts[1:]:
            found = found | name.contains(p)
        return found
    return (F.when(has("SSN", "SOCIAL_SECURITY"), "SSN")
            .when(has("CREDIT", "CARD"), "CREDIT_CARD")
            .when(has("SECRET", "KEY", "TOKEN"), "SECRET_KEY")
            .when(has("EMAIL"), "EMAIL")
            .when(has("PHONE"), "PHONE")
            .when(has("DB", "CONNECTION", "CREDENTIAL"), "DB_CONNECTION_STRING")
            .otherwise("PHI_NAME"))


def token_prefix(type_: Column) -> Column:
    return F.coalesce(literal_map(PREFIX_OF_TYPE)[type_], F.lit("PII"))


def ledger_type(type_: Column) -> Column:
    """Upper case, no NER_ prefix, blanks, dashes and brackets to underscores, four renames."""
    name = F.upper(F.when(type_.isNull() | (type_ == ""), "SECRET").otherwise(type_))
    name = F.regexp_replace(F.regexp_replace(name, "^NER_", ""), r"[\s\-\[\]]+", "_")
    return F.coalesce(literal_map(LEDGER_RENAMES)[name], name)


def entity_name(type_: Column) -> Column:
    return F.coalesce(literal_map(ENTITY_NAMES)[type_], type_)


def entity_label(type_: Column, custom: dict[str, str] | None = None) -> Column:
    """Fixed label of an entity class; ``custom`` overrides per class."""
    labels = {**ENTITY_LABELS, **(custom or {})}
    return F.coalesce(literal_map(labels)[type_], F.concat(F.lit("["), type_, F.lit("_REDACTED]")))


def entity_risk(type_: Column) -> Column:
    return F.when(type_ == "PER", "HIGH").otherwise("MEDIUM")


def count_placeholders(text: Column, pattern: str = LEDGER_STYLE) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def extract_placeholders(text: Column, pattern: str = NUMBERED) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def mark_placeholders(text: Column, before: str = "<mark>", after: str = "</mark>") -> Column:
    """Escape markup and wrap every placeholder."""
    safe = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")),
                               F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(safe, f"({ANY_MARK})", f"{before}$1{after}")


def split_on_placeholders(text: Column, pattern: str = NUMBERED) -> Column:
    """Text pieces and placeholders in order (pieces may be empty)."""
    gaps, hits = F.split(text, pattern, -1), extract_placeholders(text, pattern)
    pairs = F.zip_with(gaps, hits, lambda g, h: F.array(g, h))
    return F.filter(F.flatten(pairs), lambda x: x.isNotNull())
