"""Shannon entropy and the high-entropy predicate."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from veilframe.columns import let


def shannon_entropy(value: Column, digits: int | None = None) -> Column:
    """Bits per character; ``digits`` rounds the result (the client rounds to 3)."""
    def of(text):
        n = F.length(text).cast("double")

        def share(ch):
            # Removing a character and comparing lengths counts it without a lambda per place.
            return (n - F.length(F.replace(text, ch, F.lit("")))) / n
        chars = F.array_remove(F.array_distinct(F.split(text, "")), "")
        # A share is worked out once, and mentioned twice in the sum.
        return F.aggregate(F.transform(chars, share), F.lit(0.0), lambda total, p: total - p * F.log2(p))
    bits = F.when(F.length(value) > 0, let(value, of)).otherwise(F.lit(0.0))
    return bits if digits is None else F.round(bits, digits)


def secret_shape(value: Column, min_length: int = 16) -> Column:
    """Long, with a letter and a digit, and no placeholder."""
    return ((F.length(value) >= min_length) & value.rlike("[a-zA-Z]") & value.rlike("[0-9]")
            & ~(value.startswith("[") & value.endswith("]")))


def is_high_entropy(value: Column, threshold: float = 3.7, min_length: int = 16,
                    strict: bool = False, digits: int | None = 3) -> Column:
    """Long, holds a letter and a digit, is no placeholder, and reaches the threshold.

    Client: rounded to 3 digits and ``>= 3.7``. Gateway: ``strict`` and ``> 3.8``, not
    rounded. Extension: ``strict`` and ``> 3.7``.
    """
    return reaches(F.when(secret_shape(value, min_length), shannon_entropy(value)), threshold, strict, digits)


def reaches(bits: Column, threshold: float = 3.7, strict: bool = False, digits: int | None = 3) -> Column:
    """The same for an entropy that is at hand; null, of what has no secret's shape, reaches nothing."""
    bits = bits if digits is None else F.round(bits, digits)
    return F.coalesce(bits > threshold if strict else bits >= threshold, F.lit(False))
