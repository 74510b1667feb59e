"""Connected components of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veilframe.llm.common import discard, written


def _towards_least(edges: DataFrame, both: bool) -> DataFrame:
    """One star step. `edges` are (a, b) with a > b.

    both: the greater neighbours of each node are tied to its least one (or the node itself);
    else the node and its lesser neighbours are tied to the least of these.
    """
    ties = edges
    if both:
        ties = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = ties.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    met = ties.join(least, "a")
    if both:
        made = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        made = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return made.where("a > b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every node is either tied to one lesser node or has others tied to it, not both."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return sums.where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node that has an edge, and the least node that it reaches.

    `edges` has the columns a and b (long). Alternates the two star steps until all edges lead to roots,
    about log(longest path) rounds; each round is a table in the shared folder. Minima are
    aggregated before the shuffle, and a node with very many neighbours meets a table that is
    unique per node, which adaptive execution splits. Nulls, loops and repeated edges count for
    nothing; no edges give no rows.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "edges")
    while not _stars(edges):
        before, edges = edges, written(_towards_least(_towards_least(edges, both=True), both=False), "edges")
        discard(before)
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
