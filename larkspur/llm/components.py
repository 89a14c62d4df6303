"""Connected components of a graph given as a table of edges, by alternating large and small stars.

Each round has two steps. A large star ties every larger neighbour of a node to the smallest node in sight; a small
star does the same with the smaller neighbours. Both are a grouped minimum (combined before the shuffle, so that a
node with very many neighbours costs one row from each task) and an equi-join, whose skewed keys Spark splits. The
edges end as a star around each component's smallest node, after a number of rounds that grows with the logarithm
of the longest path. Every round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import released, stored


def _star(edges: DataFrame, small: bool) -> tuple[DataFrame, DataFrame]:
    """edges: a > b. Large star: all neighbours of each node; small star: the smaller ones. Also the table on the way."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    least = stored(least, "least")  # so that both sides of the join are plain shuffles, whose skew Spark splits
    tied = both.join(least, "a")
    if small:
        moved = tied.select(F.col("b").alias("a"), F.col("low").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("low").alias("b")))
    else:
        moved = tied.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.where(F.col("a") != F.col("b")).distinct(), least


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that has an edge: root is the smallest node reachable. Loops, repeated edges
    and nulls are dropped first; an empty table gives no rows."""
    now = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    now = stored(now.where(F.col("a") != F.col("b")).distinct(), "edges")
    seen = None
    while True:
        large, one = _star(now, small=False)
        small, other = _star(large, small=True)
        before, now = now, stored(small, "stars")
        for table in (before, one, other):  # a round's tables go when the next is written
            released(table)
        told = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if told == seen:
            break
        seen = told
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
