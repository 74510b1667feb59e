"""Resolving overlapping spans inside a row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from veilframe.columns import append, empty_like, fold_in_blocks, let


#: Spans of one overlapping chain that are tested pairwise.
CHAIN = 32


def in_text_order(spans: Column) -> Column:
    return F.transform(
        F.array_sort(F.transform(spans, lambda s, i: F.struct(
            s["start"].alias("a"), i.alias("b"), s.alias("s")))), lambda k: k["s"])


def leftmost(spans: Column, longest: bool = True) -> Column:
    """Greedy from the left; at one start the longest wins, then detector order.

    ``longest=False`` looks at the start only. One sort, and one pass in blocks.
    """
    def resolve(ss):
        keyed = F.array_sort(F.transform(ss, lambda s, i: F.struct(
            s["start"].alias("a"), (s["start"] - s["end"] if longest else F.lit(0)).alias("b"),
            i.alias("c"), s.alias("s"))))
        return fold_in_blocks(keyed, F.lit(0), lambda edge, k: k["s"]["end"], lambda edge, k: k["s"],
                              empty_like(ss), lambda edge, k: k["s"]["start"] >= edge)
    return let(spans, lambda ss: F.when(F.size(ss) <= 1, ss).otherwise(resolve(ss)))


def longest_first(spans: Column) -> Column:
    """Greedy by length, ties in detector order; result in text order.

    Spans are first cut into groups that touch each other. In a small group each span is
    tested against all kept ones; in a long chain, kept spans stay in text order and the only
    one that can be in the way is found by binary search.
    """
    def ranked(group):
        return F.array_sort(F.transform(group, lambda k: F.struct(
            (k["s"]["start"] - k["s"]["end"]).alias("a"), k["b"].alias("b"), k["s"].alias("s"))))

    def none(group):
        return F.transform(empty_like(group), lambda k: k["s"])

    def greedy(group):
        kept = F.aggregate(ranked(group), none(group),
                           lambda acc, k: F.when(
                               F.exists(acc, lambda o: (k["s"]["start"] < o["end"])
                                        & (k["s"]["end"] > o["start"])), acc
                           ).otherwise(append(acc, k["s"])))
        return in_text_order(kept)

    def before(kept, end):
        """How many kept spans start before ``end``: halving an interval of places."""
        def halve(acc, _):
            mid = F.shiftright(acc["low"] + acc["high"], 1)
            right = F.get(kept, mid)["start"] < end
            return F.when(acc["low"] >= acc["high"], acc).when(right, F.struct(
                (mid + 1).alias("low"), acc["high"].alias("high"))).otherwise(F.struct(
                    acc["low"].alias("low"), mid.alias("high")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(31)), F.struct(
            F.lit(0).alias("low"), F.size(kept).alias("high")), halve, lambda acc: acc["low"])

    def searched(group):
        def add(kept, k):
            # Kept spans are disjoint: only the last that starts before this one's end can reach into it.
            return let(before(kept, k["s"]["end"]), lambda n: F.when(
                F.coalesce(F.get(kept, n - 1)["end"] > k["s"]["start"], F.lit(False)), kept
            ).otherwise(F.array_insert(kept, n + 1, k["s"])))
        return F.aggregate(ranked(group), none(group), add)

    def resolve(ss):
        keyed = F.array_sort(F.transform(ss, lambda s, i: F.struct(
            s["start"].alias("a"), i.alias("b"), s.alias("s"))))

        def groups(ks):
            reach = fold_in_blocks(ks, F.lit(-1), lambda r, k: F.greatest(r, k["s"]["end"]),
                                   lambda r, k: r, F.array().cast("array<int>"))

            def cut(rs):
                firsts = F.filter(F.sequence(F.lit(0), F.size(ks) - 1),
                                  lambda i: F.get(ks, i)["a"] >= F.get(rs, i))
                return let(firsts, lambda fs: F.transform(fs, lambda f, j: F.slice(
                    ks, f + 1, F.coalesce(F.get(fs, j + 1), F.size(ks)) - f)))
            return let(reach, cut)
        return F.flatten(F.transform(let(keyed, groups), lambda g: F.when(
            F.size(g) <= 1, F.transform(g, lambda k: k["s"])).when(
            F.size(g) <= CHAIN, greedy(g)).otherwise(searched(g))))
    return let(spans, lambda ss: F.when(F.size(ss) <= 1, ss).otherwise(resolve(ss)))


def overlaps_any(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (span["start"] < o["end"]) & (span["end"] > o["start"]))


def drop_overlapping(spans: Column, others: Column) -> Column:
    """Spans that touch none of ``others``."""
    return let(others, lambda o: F.filter(spans, lambda s: ~overlaps_any(s, o)))


def drop_known_entities(contextual: Column, model: Column) -> Column:
    """Contextual entities that no model entity equals, or contains with the same type."""
    return let(model, lambda known: F.filter(contextual, lambda c: ~F.exists(known, lambda m: (
        ((m["start"] == c["start"]) & (m["end"] == c["end"]))
        | ((m["start"] <= c["start"]) & (m["end"] >= c["end"]) & (m["type"] == c["type"]))))))
