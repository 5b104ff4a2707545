"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Workspace

FEW = 100_000  # nodes of 16 bytes


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    least = F.broadcast(least) if few else least
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(F.broadcast(least) if few else least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, work: Workspace, name: str = "stars") -> DataFrame:
    """(node, root) for every node of ``edges`` (``u``, ``v``) but the roots; a root is its component's least node.

    Edges stay distributed; each round ends in a written table, and rounds grow with the
    logarithm of the longest path.  Nodes' least neighbours join the edges by broadcast while
    there are at most ``FEW`` nodes; beyond that a shuffle, whose skewed keys Spark splits.
    """
    edges = work.table(edges.filter("u != v"), f"{name}0")
    seen, k = (edges.count(), None), 0
    while True:
        k += 1
        few = 2 * seen[0] <= FEW
        edges = work.table(_small_star(_large_star(edges, few), few), f"{name}{k}")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        work.drop(f"{name}{k - 1}")
        if state == seen or state[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
