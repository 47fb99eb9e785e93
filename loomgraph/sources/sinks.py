"""Writers, and the reader that takes back what they write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators.arcs import twins, with_ends
from loomgraph.operators.contigs import numbered
from loomgraph.plans.session import stored_count


def fasta_lines(contigs: DataFrame) -> DataFrame:
    return contigs.select(F.concat(F.lit(">"), "name", F.lit("\n"), "seq").alias("value"))


def write_fasta(contigs: DataFrame, path: str) -> None:
    """Well-formed FASTA, a part file a partition."""
    fasta_lines(contigs).write.text(path)


def write_histogram(histogram: DataFrame, path: str) -> None:
    """A thousand lines, the n of bins 0 to 999 in order."""
    histogram.coalesce(1).sortWithinPartitions("mult_bin").select(F.col("n").cast("string").alias("value")).write.text(path)


def removed_contigs(removed: DataFrame) -> DataFrame:
    """Removed sequences longer than 100 as contigs, numbered from 1 by falling length, then sequence."""
    return numbered(removed.where(F.length("seq") > 100).select(F.lit("contig_RemovedNo").alias("name"), "seq")).select(F.regexp_replace("name", "No_", "No").alias("name"), "seq")


def slots_wide(arcs: DataFrame) -> DataFrame:
    """src and, per slot, the arc string a0..a7 and multiplicity m0..m7 (empty and 0 where there is no arc)."""
    at = lambda i, c, none: F.coalesce(F.max(F.when(F.col("arc_idx") == i, F.col(c))), F.lit(none)).alias(f"{'a' if c == 'seq' else 'm'}{i}")
    return arcs.groupBy("src").agg(*(at(i, "seq", "") for i in range(8)), *(at(i, "mult", 0) for i in range(8)))


def graph_lines(arcs: DataFrame) -> DataFrame:
    """A line a node: the k-mer, eight arc strings ending in '#', eight multiplicities."""
    wide = slots_wide(arcs)
    return wide.select(F.concat_ws(" ", "src", *(F.concat(f"a{i}", F.lit("#")) for i in range(8)), *(F.col(f"m{i}").cast("string") for i in range(8))).alias("value"))


def adjacency_lines(adjacency: DataFrame) -> DataFrame:
    """A line a node: the k-mer and its neighbours, right ones first."""
    return adjacency.select(F.rtrim(F.concat_ws(" ", "src", F.nullif("right_next", F.lit("")), F.nullif("left_next", F.lit("")))).alias("value"))


def edge_lines(edges: DataFrame, weight: str) -> DataFrame:
    """A line an arc: its ends and a weight, by tabs."""
    return edges.select(F.concat_ws("\t", "src", "dst", F.col(weight).cast("string")).alias("value"))


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """src, arc_idx, seq, mult from graph_lines() as written; blanks may pad the columns."""
    cut = spark.read.text(path).select(F.split(F.trim("value"), " +").alias("x")).where(F.size("x") == 17)
    slots = F.explode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(i.alias("arc_idx"), F.rtrim(F.get("x", i + 1), F.lit("#")).alias("seq"), F.get("x", i + 9).cast("long").alias("mult"))))
    return cut.select(F.get("x", F.lit(0)).alias("src"), slots.alias("s")).select("src", "s.*").where(F.length("seq") > 0)


def load_graph(spark: SparkSession, path: str, k: int) -> DataFrame:
    """A stored table of the arcs of a graph file, from which an assembly can go on.

    The file has no coverages, so an arc's is its multiplicity times its length; ends follow from the strings. A file of
    another k, or with an arc whose twin is missing, is refused.
    """
    read = read_graph(spark, path)
    arcs = read.select("src", "arc_idx", "seq", F.length("seq").cast("long").alias("len"), (F.col("mult") * F.length("seq")).alias("cov"), "mult")
    arcs, n = stored_count(with_ends(arcs, k), "loaded")
    odd = arcs.where(F.length("src") != k).count()
    alone = n - twins(arcs, k).count()
    if odd or alone:
        raise ValueError(f"{path}: {odd} arcs of k-mers that have not {k} bases, {alone} arcs without a twin")
    return arcs
