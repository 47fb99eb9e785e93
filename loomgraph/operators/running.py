"""Running sums over a whole table, without a task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.plans.session import stored


def ranged(df: DataFrame, *order: Column) -> DataFrame:
    """A stored table of df in partitions of rising order, numbered by part."""
    return stored(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")


def running(parts: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """A table of ranged() with, for each name, the sum over all rows before a row in that order.

    Rows of one part meet in one task; of each part only its sums go on, which are carried to the parts behind it.
    """
    totals = parts.groupBy("part").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()))
    ahead = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part
    carried = totals.select("part", *(F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"_{n}") for n in sums))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = parts.withColumns({n: F.coalesce(F.sum(c).over(within), F.lit(0)) for n, c in sums.items()})
    met = own.join(F.broadcast(carried), "part")  # a row a part
    return met.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop(*(f"_{n}" for n in sums))
