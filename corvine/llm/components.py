"""Connected components of a links table, with DataFrame operations only and nothing gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node reachable from each node of ``links`` (a, b), two long columns, in any direction.

    Each round, every node takes the least of itself and its neighbours, then what that one took; links are rewritten to
    what their ends took, and those within one node, and repeated ones, go. Every node that still has links merges with
    another, so links and rounds shrink geometrically. The least node always takes itself, so it names its component.
    Minima are partly computed before each shuffle, so a node with very many links weighs on no single task.
    """
    links = keep(_both_ways(links.select("a", "b")))
    roots = None
    while not links.isEmpty():
        took = keep(links.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")))
        further = took.select(F.col("node").alias("up"), F.col("up").alias("root"))
        level = keep(took.join(further, "up").select("node", "root"))
        if roots is None:
            roots = level
        else:
            roots = keep(roots.join(level.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root")))
        ends = links.where("a < b")
        for end in "ab":
            ends = ends.join(level.select(F.col("node").alias(end), F.col("root").alias(f"to_{end}")), end)
        links = keep(_both_ways(ends.select(F.col("to_a").alias("a"), F.col("to_b").alias("b"))))
    if roots is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.select("node", F.col("root").alias("component"))


def _both_ways(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct()
