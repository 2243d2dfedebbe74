"""Connected components of a graph too large for one machine, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaseloom.llm.staging import Work


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a > b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of them (edges lead from the larger to the smaller end)."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def connected_components(edges: DataFrame, work: Work, name: str) -> DataFrame:
    """(node, component) for every node of `edges` (a, b) that is not the smallest of its component; the component is that smallest node.

    Self-loops and edges with a null end are ignored. Each round is written out, so a lost executor costs no more than its round; it ends
    when a round changes nothing. The smallest neighbour is an aggregate, so a node with very many edges is summed before the shuffle."""
    ends = edges.filter("a is not null and b is not null and a <> b")
    now = work.stored(f"{name}_0", ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    before, turn = state(now), 0
    while before[0]:
        turn += 1
        after = work.stored(f"{name}_{turn}", small_star(large_star(now)))
        work.delete(f"{name}_{turn - 1}")
        now, then = after, before
        before = state(now)
        if before == then:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
