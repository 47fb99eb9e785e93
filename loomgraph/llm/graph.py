"""Connected components of an edge table, by alternating star contractions.

Nodes may be of any orderable type. Each step is a grouped minimum (combined before the shuffle) and a join that AQE splits
where a node has very many neighbours; results are written to the shared folder, so nothing depends on one executor.
Few edges are kept in few tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import fitted
from loomgraph.plans.session import discard, stored


def _large(edges: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return fitted(fitted(tied, n).distinct(), n)


def _small(edges: DataFrame, n: int) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is tied to the smallest of them. Edges have b < a."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return fitted(fitted(others.union(least.select("a", F.col("m").alias("b"))), n).distinct(), n)


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of edges (a, b)."""
    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = stored(now, "edges"), None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == seen or not mark[0]:
            break
        seen, before = tuple(mark), now
        now = stored(_small(_large(now, mark[0]), mark[0]), "edges")
        discard(before)
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
