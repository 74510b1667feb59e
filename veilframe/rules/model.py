"""A detection rule, and the regular-expression dialects it is written out in."""

from __future__ import annotations

import re
import string
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from veilframe.columns import any_of, text_or_empty

WORD = r"\w"
# An ASCII word boundary, spelled out because Java's own depends on the JVM version.
EDGE = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


_SETS = {"w": string.digits + string.ascii_letters + "_", "d": string.digits, "s": " \t\n\x0b\f\r"}
_ITEM = r"\\[wds]|\\[^A-Za-z0-9]|[^\\\[\]&^]"


def _listed(found: re.Match) -> str:
    """A class of ASCII characters with all of them written out, which Java looks up in one table of bits."""
    items = re.findall(_ITEM, found[1])
    chars: set[str] = set()
    at = 0
    while at < len(items):
        item = items[at]
        if len(item) == 2 and item[1] in _SETS:
            chars |= set(_SETS[item[1]])
        elif at + 2 < len(items) and items[at + 1] == "-":
            first, last = item[-1], items[at + 2][-1]
            if len(items[at + 2]) == 2 and last in _SETS or ord(last) - ord(first) > 128:
                return found[0]
            chars |= {chr(c) for c in range(ord(first), ord(last) + 1)}
            at += 2
        else:
            chars.add(item[-1])
        at += 1
    if len(chars) < 9 or not all(c.isascii() for c in chars):
        return found[0]
    made = "[" + "".join(c if c.isalnum() or c == "_" else f"\\x{ord(c):02x}" for c in sorted(chars)) + "]"
    least = found[2]  # of {n,}: Java runs a plain + over a class as one loop
    return made if not least else f"{made}{{{int(least) - 1}}}{made}+" if int(least) > 1 else made + "+"


def listed_classes(pattern: str) -> str:
    """The same pattern in a form that Java runs faster; negated, nested and other classes stay as they are."""
    return re.sub(rf"(?<!\\)\[((?:{_ITEM})+)\](?:\{{([1-9]\d*),\}}(?![+?]))?", _listed, pattern)


def java_regex(core: str, left: str = "", right: str = "") -> str:
    """``core`` with ASCII word boundaries for the JVM.

    ``word``: the core always starts (ends) with a word character, so one lookaround
    is enough. ``edge``: it may start (end) with another character, so both are needed.
    """
    before = {"": "", "word": f"(?<!{WORD})", "edge": EDGE}[left]
    after = {"": "", "word": f"(?!{WORD})", "edge": EDGE}[right]
    if core.startswith("(?i)"):
        return listed_classes("(?i)" + before + core[4:] + after)
    return listed_classes(before + core + after)


@dataclass(frozen=True)
class Rule:
    id: str
    core: str
    left: str = ""
    right: str = ""
    type: str = ""            # span type; the id unless several rules share one
    label: str = ""           # fixed replacement text
    category: str = ""
    risk: str = ""
    confidence: float = 0.0
    check: str = ""           # name of a validator
    near: tuple[str, ...] = ()  # one of these must stand within 50 characters
    group: int = 0            # capture group that is the span
    any_literal: tuple[str, ...] = ()  # cheap gate: one of these occurs ...
    fold_case: bool = False   # ... in the lower-cased text
    gate: str = ""            # cheap gate: this unanchored pattern occurs
    signal: str = ""          # cheap gate shared with other rules, see TextView
    words: tuple[str, ...] = ()  # cheap gate: one of these capitalised words occurs
    jvm: str = ""             # the same matches in a form that Java runs without recursion ...
    jvm_group: int = 0        # ... in which this group is the span, if it took part

    @property
    def span_type(self) -> str:
        return self.type or self.id

    @property
    def regex(self) -> str:
        return listed_classes(self.jvm) if self.jvm else java_regex(self.core, self.left, self.right)

    @property
    def span_group(self) -> int:
        return self.jvm_group or self.group

    @property
    def methods(self) -> tuple[str, ...]:
        found = ["REGEX"]
        if self.check:
            found.append("CHECKSUM")
        if self.near:
            found.append("PROXIMITY_ANCHOR")
        return tuple(found)

    def with_(self, **changes) -> "Rule":
        return replace(self, **changes)

    def may_match(self, view: "TextView") -> Column | None:
        """A necessary condition that is much cheaper than the rule's own pattern."""
        tests = []
        if self.signal and self.signal in view.signals:
            tests.append(view.signals[self.signal])
        if self.words:
            words = view.signals.get("words", capitalised_words(view.text))
            tests.append(F.arrays_overlap(words, F.lit(list(self.words))))
        if self.any_literal:
            haystack = view.lowered if self.fold_case else view.text
            tests.append(any_of(haystack.contains(lit) for lit in self.any_literal))
        if self.gate:
            tests.append(view.text.rlike(listed_classes(self.gate)))
        return reduce(lambda x, y: x & y, tests) if tests else None


# One pass over the text answers for a whole group of rules.
SIGNALS = {
    "numeric": r"\d[\d.\-\s]{6}",
    "caps": r"[A-Z]{2}[A-Z0-9]{6}",
    "long": listed_classes(r"[\w.\-]{16}"),
}


def capitalised_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?<!{WORD})[A-Z][A-Za-z]*"), F.lit(0))


@dataclass(frozen=True)
class TextView:
    """A text column with what the gates look at: lower-cased text and shared signals."""

    text: Column
    lowered: Column
    signals: dict[str, Column] = field(default_factory=dict)


def add_view(df: DataFrame, text: str, rules) -> tuple[DataFrame, TextView, list[str]]:
    """Add the columns of a view that ``rules`` need; returns their names for dropping."""
    rules = tuple(rules)
    df = df.withColumn("_text", text_or_empty(text))
    body = F.col("_text")
    wanted = {r.signal for r in rules if r.signal}
    added = {"_lowered": F.lower(body)}
    added |= {"_" + s: body.rlike(SIGNALS[s]) for s in SIGNALS if s in wanted}
    if any(r.words for r in rules):
        added["_words"] = capitalised_words(body)
    df = df.withColumns(added)
    view = TextView(body, F.col("_lowered"),
                    {name[1:]: F.col(name) for name in added if name != "_lowered"})
    return df, view, ["_text", *added]


def select_rules(rules, *, ids=None, categories=None, risks=None, min_confidence=None):
    """Catalogue selection by id, category, risk and confidence."""
    return tuple(
        r for r in rules
        if (ids is None or r.id in ids)
        and (categories is None or r.category in categories)
        and (risks is None or r.risk in risks)
        and (min_confidence is None or r.confidence >= min_confidence)
    )


def rules_frame(spark, rules):
    """The catalogue as a DataFrame, for joins."""
    rows = [(i, r.id, r.span_type, r.category, r.risk, float(r.confidence), r.label,
             bool(r.check), bool(r.near)) for i, r in enumerate(rules)]
    return spark.createDataFrame(
        rows, "ord int, rule_id string, type string, category string, risk string, "
              "confidence double, label string, has_check boolean, has_proximity boolean")
