"""Small helpers for building Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``.

    A column expression that is mentioned twice inside a higher-order function is
    evaluated twice; binding it as a lambda variable evaluates it once.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def pinned(value: Column) -> Column:
    """A costly expression that Spark must compute once, where it stands.

    Spark pushes a filter on a computed column below the projection by copying the
    expression, here all regular expressions of a catalogue. It never copies an
    expression with a random part; ``rand`` is never negative, so the value is unchanged.
    Filters on other columns are not pushed below it either: filter before scanning.
    """
    # A bare comparison of rand with a constant would be folded away.
    return F.when(F.rand(0) + F.lit(1.0) >= F.lit(1.0), value)


def empty_like(array: Column) -> Column:
    """An empty array with the element type of ``array``."""
    return F.slice(array, 1, 0)


def append(array: Column, item: Column) -> Column:
    return F.concat(array, F.array(item))


#: Items that are folded at once; a fold copies its growing result at each step.
BLOCK = 256


def in_blocks(array: Column) -> Column:
    """The array cut into arrays of BLOCK items."""
    n = F.ceil(F.size(array) / F.lit(BLOCK)).cast("int")
    return F.transform(
        F.filter(F.sequence(F.lit(0), n), lambda b: b < n),
        lambda b: F.slice(array, b * BLOCK + 1, F.lit(BLOCK)))


def fold_in_blocks(array: Column, start: Column, step: Callable[[Column, Column], Column],
                   item: Callable[[Column, Column], Column], empty: Column,
                   keep: Callable[[Column, Column], Column] | None = None, after: bool = False) -> Column:
    """A fold that gives an item for each step: ``item(state, x)`` before ``step(state, x)``, or of the new state (``after``).

    Where ``keep(state, x)`` is false neither happens; ``empty`` is an empty array of items. The items of a block are gathered
    first and blocks put together last, so the work is about linear in the array.
    """
    def one(acc, x):
        moved = let(step(acc["state"], x), lambda s: F.struct(s.alias("state"), append(acc["out"], item(s, x)).alias("out"))
                    ) if after else F.struct(step(acc["state"], x).alias("state"),
                                             append(acc["out"], item(acc["state"], x)).alias("out"))
        return moved if keep is None else F.when(keep(acc["state"], x), moved).otherwise(acc)

    def block(acc, xs):
        done = F.aggregate(xs, F.struct(acc["state"].alias("state"), empty.alias("out")), one)
        return let(done, lambda r: F.struct(r["state"].alias("state"),
                                            append(acc["blocks"], r["out"]).alias("blocks")))
    def blocks(xs):
        return F.flatten(F.aggregate(
            in_blocks(xs), F.struct(start.alias("state"), empty_like(F.array(empty)).alias("blocks")),
            block, lambda acc: acc["blocks"]))
    return let(array, lambda xs: F.when(F.size(xs) <= BLOCK, F.aggregate(
        xs, F.struct(start.alias("state"), empty.alias("out")), one, lambda acc: acc["out"]))
        .otherwise(blocks(xs)))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def text_or_empty(text: Column | str) -> Column:
    """Null text counts as the empty string everywhere in this package."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def trim_blank(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")
