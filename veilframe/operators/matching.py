"""Finding the matches of a rule list: one pass of a task over a batch of texts.

A rule's pattern means the same to Java and to Python, whose classes are held to ASCII here as Java's are. The tasks get
the texts in Arrow batches and give back places only; what a place means is told by Spark's own functions.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Sequence
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

from veilframe.columns import pinned
from veilframe.rules.model import Rule

# Workers may not have this library on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: ``free`` tells whether a hit is kept when hits alone are resolved from the left, longest and then earliest rule first.
HITS = "array<struct<rule:int,start:int,end:int,value:string,entropy:double,free:boolean>>"
_HIT = pa.struct([("rule", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()),
                  ("entropy", pa.float64()), ("free", pa.bool_())])

DIGIT, LETTER, PLACE = re.compile("[0-9]").search, re.compile("[a-zA-Z]").search, itemgetter(0, 1, 2)


def _texts(column: pa.Array) -> tuple[list[str], pa.Array]:
    """The texts, also as a column; null is empty, and bytes that are no UTF-8 are read as Java reads them."""
    column = pc.fill_null(column, "")
    try:
        return column.to_pylist(), column
    except UnicodeDecodeError:
        texts = [raw.decode("utf-8", "replace") for raw in column.cast(pa.binary()).to_pylist()]
        return texts, pa.array(texts, pa.large_string())


def _bits(value: str, shares: dict[int, list[float]]) -> float:
    """Shannon entropy, summed in the order of ``shannon_entropy``; Java's logarithm differs in the last bit for some shares.

    ``shares`` keeps p * log2 p for each number of a length's characters.
    """
    n, total = len(value), 0.0
    if n not in shares:
        shares[n] = [0.0] + [c / n * (math.log(c / n) / math.log(2.0)) for c in range(1, n + 1)]
    own = shares[n]
    for char in dict.fromkeys(value):
        total -= own[value.count(char)]
    return total


def _linear(core: str) -> str:
    """A pattern without its lookarounds for Arrow's own matcher, whose blanks lack the vertical tab."""
    out, at, inside = [], 0, False
    while at < len(core):
        size = 2 if core[at] == "\\" else 1
        item = core[at:at + size]
        inside = item == "[" or inside and item != "]"
        out.append(item if item != r"\s" else r"\s\x0b" if inside else r"[\s\x0b]")
        at += size
    return "".join(out)


def rule_hits(text: Column, rules: Sequence[Rule], listed: dict[int, Sequence[str]] | None = None,
              entropy: dict[int, float] | None = None) -> Column:
    """Every match of every rule (``HITS``) in the order of ``free``; rules are told by their index.

    ``listed`` holds, for an index, the only values that count; ``entropy`` the bits that a value must exceed, which
    must also have a letter and a digit. Rules with checks, proximity or groups are not for this.
    """
    if any(r.check or r.near or r.span_group for r in rules):
        raise ValueError("checks, proximity and groups are not looked at here")
    # Arrow tells for a whole batch which texts may match: they hold a literal, or match without lookarounds.
    plain = [(i, r.regex, () if r.fold_case else r.any_literal, _linear(r.core)) for i, r in enumerate(rules)]
    values = {i: frozenset(v) for i, v in (listed or {}).items()}
    bounds = dict(entropy or {})

    def find(column: pa.Array) -> pa.Array:
        texts, column = _texts(column)
        hits: dict[int, list] = {}
        shares: dict[int, list[float]] = {}
        for i, pattern, literals, core in plain:
            may = (reduce(pc.or_, [pc.match_substring(column, literal) for literal in literals]) if literals
                   else pc.match_substring_regex(column, core))
            matches, only, bound = re.compile(pattern, re.ASCII).finditer, values.get(i), bounds.get(i)
            for row in np.flatnonzero(may.to_numpy(zero_copy_only=False)).tolist():
                for match in matches(texts[row]):
                    value, measure = match[0], None
                    if only is not None and value not in only:
                        continue
                    if bound is not None:
                        if not (DIGIT(value) and LETTER(value)):
                            continue
                        measure = _bits(value, shares)
                        if measure <= bound:
                            continue
                    hit = (match.start(), -match.end(), i, value, measure)
                    if row in hits:
                        hits[row].append(hit)
                    else:
                        hits[row] = [hit]
        sizes = np.zeros(len(texts) + 1, np.int32)
        rule, start, end, value, bits, free = [], [], [], [], [], []
        for row in sorted(hits):
            found, edge = hits[row], 0
            sizes[row + 1] = len(found)
            if len(found) > 1:
                found.sort(key=PLACE)
            for at, to, i, held, measure in found:
                rule.append(i)
                start.append(at)
                end.append(-to)
                value.append(held)
                bits.append(measure)
                free.append(at >= edge)
                if at >= edge:
                    edge = -to
        flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip((rule, start, end, value, bits, free), _HIT)],
                                          fields=list(_HIT))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), flat)

    find.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return pinned(F.arrow_udf(find, HITS)(text))
