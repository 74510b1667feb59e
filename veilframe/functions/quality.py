"""Proximity, offset checks, payload size, and receipt risk."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from veilframe.columns import any_of, let

RECEIPT_LIMIT_BYTES = 2048
REQUEST_LIMIT_BYTES = 64 * 1024


def window_around(text: Column, start: Column, end: Column, window: int = 50) -> Column:
    """Lower-cased text from ``window`` characters before a span to as many after it."""
    begin = F.greatest(F.lit(0), start - window)
    return F.lower(F.substring(text, begin + 1, end + window - begin))


def near_keyword(text: Column, start: Column, length: Column, keywords,
                 window: int = 50) -> Column:
    """Does any keyword stand within ``window`` characters of the span?"""
    if not keywords:
        return F.lit(True)
    around = window_around(text, start, start + length, window)
    return any_of(around.contains(k.lower()) for k in keywords)


def offsets_hold(text: Column, spans: Column) -> Column:
    """Every span's offsets cut exactly its value out of the text."""
    return let(text, lambda t: F.forall(spans, lambda s: F.substring(
        t, s["start"] + 1, s["end"] - s["start"]) == s["value"]))


def payload_bytes(*columns: Column | str) -> Column:
    """UTF-8 size of the row's JSON form."""
    return F.octet_length(F.to_json(F.struct(*columns)))


def receipt_risk_level(risks: Column) -> Column:
    return F.when(F.exists(risks, lambda r: r == "CRITICAL"), "CRITICAL").otherwise("HIGH")


def receipt_risk_score(n: Column) -> Column:
    return F.least(F.lit(100), n * 22 + 45)
