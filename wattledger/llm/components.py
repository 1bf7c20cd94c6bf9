"""Connected components of a graph given by its edges, by alternating large and small stars.

In a large-star step every node links its larger neighbours to its smallest one,
in a small-star step its smaller ones. Each step is an aggregation to one row per
node and a join, both of which split large groups; the number of rounds grows
with the logarithm of the longest path. Only few edges may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SENT_ROWS, stored, unsent


def _least(edges: DataFrame, few: bool) -> DataFrame:
    """(u, m): the smallest of a node and its neighbours, over edges in both directions."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return least if few else unsent(least)


def _large_star(edges: DataFrame, few: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both, few), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, few: bool) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down, few)
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _round(edges: DataFrame, rows: int) -> DataFrame:
    """A large and a small star of so many edges. The first is stored, since the second reads it twice and plans would grow with every use."""
    few = rows <= SENT_ROWS
    star = stored(_large_star(edges, few).distinct(), "star")  # no more edges than before
    return _small_star(star, few).filter("u <> v").distinct()


def closer(edges: DataFrame) -> DataFrame:
    """Edges (u, v), v below u, that connect the same nodes in fewer steps: one round of what ``components`` does."""
    now = stored(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    return stored(_round(now, now.count()), "closer")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v): component is the smallest node that can be reached.

    Loops and repeated edges do no harm, null ends are left out. Nodes without an
    edge to another node are not returned.
    """
    now = stored(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    before, rows = None, now.count()
    while True:
        now = stored(_round(now, rows), "edges")
        sums = now.selectExpr("count(*)", "sum(cast(u as decimal(38, 0)))", "sum(cast(xxhash64(u, v) as decimal(38, 0)))").first()
        if sums == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before, rows = sums, sums[0]
