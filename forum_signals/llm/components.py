"""Connected components of an edge table by alternating star operations.

Each round rewires edges towards smaller neighbours (large star: the larger neighbours of a node; small star: the node
and its smaller neighbours), so that every component becomes one star around its smallest node. Per node a round needs a
minimum, which is combined map-side, and a join of narrow edges, whose hot nodes Spark's skew join can split; no group
is ever collected. A round ends in a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forum_signals.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node that has an edge; the component is its smallest node.

    ``edges`` has two columns of one ordered type, in any direction. Loops and edges with a null end are ignored;
    repeated edges count once. No edges give an empty table.
    """
    u, v = edges.columns[:2]
    current = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u != v")
    current = stored(current.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    while not current.isEmpty():
        moved = stored(_small_star(_large_star(current)), name)
        if _same(current, moved):
            break
        current = moved
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables of distinct edges hold the same edges, by count and two hash sums."""
    edge = [F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.hash("u", "v").cast("long"))]
    return a.agg(*edge).first() == b.agg(*edge).first()
