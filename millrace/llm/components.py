"""Connected components of a link table by alternating star contraction.

A large-star step ties every larger neighbour of a node to the smallest one; a small-star step does so
for the smaller neighbours. Both are a minimum per node (summed up before the shuffle) and a join on the
node, whose hot side Spark can split; a round's links never outnumber the first ones, and rounds grow
with the logarithm of a component's size. Each round is written to the shared folder; the driver sees two
numbers a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import written


def _tied(links: DataFrame, smallest: DataFrame) -> DataFrame:
    return links.join(smallest, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b")


def _round(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step on links (a, b) with a > b."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Dealt anew, so that both sides of the joins are plain exchanges, whose hot keys Spark can split.
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")).hint("rebalance")
    large = _tied(both.filter("b > a"), least).distinct()
    least = large.groupBy("a").agg(F.min("b").alias("least")).hint("rebalance")
    small = _tied(large, least).unionByName(least.select("a", F.col("least").alias("b")))
    return small.distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b; of one type that can be ordered): root is its component's smallest node.

    Nulls, self links and repeated links don't matter; nodes without links are not listed.
    """
    ordered = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(ordered, "links")
    print_of = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
    seen = print_of(now)
    while seen[0]:
        now = written(_round(now), "links")
        mark = print_of(now)
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
