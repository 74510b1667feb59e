"""Checksum tests as column expressions: Luhn, Verhoeff, and a registry of validators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from veilframe.columns import let

def _dihedral(a: int, b: int) -> int:
    """Product of two symmetries of a pentagon: 0-4 are turns, 5-9 are a turn and a flip."""
    turn = (a % 5 - b % 5 if a >= 5 else a % 5 + b % 5) % 5
    return turn + 5 * ((a >= 5) != (b >= 5))


# Fixed value: the permutation that is applied once more at each place.
VERHOEFF_STEP = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)

VERHOEFF_PRODUCT = [_dihedral(a, b) for a in range(10) for b in range(10)]
VERHOEFF_INVERSE = [next(b for b in range(10) if _dihedral(a, b) == 0) for a in range(10)]
VERHOEFF_PERMUTATION = list(range(10))
for _ in range(7):  # its order is eight
    VERHOEFF_PERMUTATION += [VERHOEFF_STEP[d] for d in VERHOEFF_PERMUTATION[-10:]]


def _digit_table(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def strip_separators(value: Column) -> Column:
    return F.regexp_replace(value, r"[\s-]", "")


def digits_only(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _reversed_digits(digits: Column) -> Column:
    return F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""),
                       lambda c: c.cast("int"))


def _luhn_sum(digits: Column) -> Column:
    def weigh(d, i):
        doubled = d * 2
        return F.when(i % 2 == 0, d).otherwise(
            F.when(doubled > 9, doubled - 9).otherwise(doubled))
    return F.aggregate(F.transform(_reversed_digits(digits), weigh), F.lit(0),
                       lambda a, d: a + d)


def luhn_valid(value: Column) -> Column:
    """Luhn modulo 10 over 13 to 19 digits; blanks and dashes are ignored."""
    return F.coalesce(let(strip_separators(value), lambda d: F.when(
        d.rlike(r"^[0-9]{13,19}$"), _luhn_sum(d) % 10 == 0).otherwise(False)), F.lit(False))


def luhn_valid_digits(value: Column) -> Column:
    """Luhn over whatever digits the value holds, 13 to 19 of them."""
    return luhn_valid(digits_only(value))


def lenient_card(value: Column) -> Column:
    """Luhn-valid, or any number of 15 or 16 digits (test cards)."""
    return F.coalesce(let(digits_only(value), lambda d:
                          luhn_valid(d) | F.length(d).isin(15, 16)), F.lit(False))


def _verhoeff_fold(digits: Column, shift: int) -> Column:
    product, permute = _digit_table(VERHOEFF_PRODUCT), _digit_table(VERHOEFF_PERMUTATION)
    permuted = F.transform(
        _reversed_digits(digits),
        lambda d, i: F.get(permute, ((i + shift) % 8) * 10 + d))
    return F.aggregate(permuted, F.lit(0), lambda c, p: F.get(product, c * 10 + p))


def verhoeff_valid(value: Column) -> Column:
    """Verhoeff over exactly 12 digits that do not start with 0 or 1."""
    return F.coalesce(let(strip_separators(value), lambda d: F.when(
        d.rlike(r"^[2-9][0-9]{11}$"), _verhoeff_fold(d, 0) == 0).otherwise(False)),
        F.lit(False))


def verhoeff_check_digit(value: Column) -> Column:
    inverse = _digit_table(VERHOEFF_INVERSE)
    return F.get(inverse, _verhoeff_fold(digits_only(value), 1))


VALIDATORS: dict[str, Callable[[Column], Column]] = {
    "luhn": luhn_valid,
    "luhn_digits": luhn_valid_digits,
    "lenient_card": lenient_card,
    "verhoeff": verhoeff_valid,
}


def register_validator(name: str, check: Callable[[Column], Column]) -> None:
    """Make ``check`` usable as the ``check`` of a rule."""
    VALIDATORS[name] = check
