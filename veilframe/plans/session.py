"""The interceptor: rules, entities that touch no rule span, session placeholders, safety."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from veilframe.columns import pinned
from veilframe.lineage import cut_lineage
from veilframe.operators.overlap import drop_overlapping, in_text_order
from veilframe.operators.substrings import check_outgoing
from veilframe.operators.tokens import assign_placeholders, replace_spans, span_rows
from veilframe.plans.client import with_client_spans, with_entities
from veilframe.rules.client import CLIENT_RULES
from veilframe.rules.entities import ENTITY_RULES


def intercept_spans(df: DataFrame, text: str = "text", rules=CLIENT_RULES,
                    entity_rules=ENTITY_RULES, entities: bool = True) -> DataFrame:
    """Rule spans plus the entities that overlap none of them, in text order."""
    df = with_client_spans(df, text, rules)
    if not entities:
        return df
    df = with_entities(df, text, entity_rules, out="_entities")
    free = drop_overlapping(F.col("_entities"), F.col("spans"))
    return df.withColumn("spans", pinned(in_text_order(F.concat(F.col("spans"), free)))).drop(
        "_entities")


def intercept(df: DataFrame, key: Sequence[str], scope: Sequence[str], order: str,
              text: str = "text", spanned: bool = False, check: bool = False,
              **options) -> tuple[DataFrame, DataFrame]:
    """Sanitised texts with session placeholders, and the session token table.

    The spans are needed for numbering and again for replacing, so they are written, with the key, scope
    and order alone; texts are read again and meet their places in one join. ``spanned`` says that the frame already carries its
    ``spans``. ``check`` adds the leak check.
    """
    columns = list(dict.fromkeys([*key, *scope, order]))
    found = df if spanned else intercept_spans(df, text, **options)
    rows = cut_lineage(span_rows(found, columns))
    tokens = assign_placeholders(rows, scope, order)
    if check:  # read by the replacing and by the check
        tokens = cut_lineage(tokens)
    out = replace_spans(df, rows, tokens, key, scope, text)
    body = F.coalesce(F.col(text), F.lit(""))
    out = out.withColumn("is_safe", (F.col("redacted_count") == 0) | (F.col("sanitized_text") != body))
    if check:
        out = check_outgoing(cut_lineage(out), tokens, key, scope, "sanitized_text")
    return out, tokens
