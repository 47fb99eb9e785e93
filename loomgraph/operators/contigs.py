"""Contigs and their length statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.kmers import oriented, reverse_complement
from loomgraph.operators.running import ranged, running

MIN_STATS = 200


def contigs(arcs: DataFrame, k: int, least: int = 100) -> DataFrame:
    """name, src, arc_idx, seq, len, mult of arcs whose string makes a contig of least bases, each in one direction.

    An arc and its twin spell one contig; the one from the larger k-mer is kept, and between arcs of one node the one
    with the smaller spelling.
    """
    spelled = arcs.where(F.col("len") >= max(least - k, 0)).withColumn("s", F.concat(oriented(F.col("src"), F.col("arc_idx")), F.col("seq")))
    kept = spelled.where((F.col("src") > F.col("dst")) | ((F.col("src") == F.col("dst")) & (F.col("s") <= reverse_complement(F.col("s")))))
    name = F.concat(F.lit("contig_NodeID"), "src", F.lit("_Index"), F.col("arc_idx").cast("string"), F.lit("_Len"), F.length("s").cast("string"), F.lit("_Mul"), F.col("mult").cast("string"))
    return kept.select(name.alias("name"), "src", "arc_idx", F.col("s").alias("seq"), F.length("s").cast("long").alias("len"), "mult")


def _longest() -> list[Column]:
    return [F.desc(F.length("seq")), F.asc("seq"), F.asc("name")]


def longest_first(contigs_: DataFrame) -> DataFrame:
    """Contigs by falling length, then by sequence."""
    return contigs_.orderBy(*_longest())


def numbered(contigs_: DataFrame) -> DataFrame:
    """Contigs with number, from 1 by falling length, then sequence; it ends their names. offset is the first byte of each
    in the FASTA file of all of them in that order."""
    parts = ranged(contigs_, *_longest())
    counted = running(parts, _longest(), number=F.lit(1)).withColumn("number", F.col("number") + 1)
    named = counted.withColumn("name", F.concat_ws("_", "name", F.col("number").cast("string")))
    return running(named, [F.asc("number")], offset=3 + F.octet_length("name") + F.length("seq")).drop("part")


def _by_length(contigs_: DataFrame, least: int) -> DataFrame:
    """len, n, and over longer contigs the sum of lengths (longer) and the number (before). A row a distinct length."""
    by_len = contigs_.where(F.col("len") >= least).groupBy("len").agg(F.count("*").alias("n"))
    return running(ranged(by_len, F.desc("len")), [F.desc("len")], longer=F.col("len") * F.col("n"), before=F.col("n"))


def _totals(run: DataFrame) -> DataFrame:
    return run.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("contig_num"), F.coalesce(F.sum(F.col("len") * F.col("n")), F.lit(0)).cast("long").alias("total_len"))


def statistics(contigs_: DataFrame, reference_length: int, least: int = MIN_STATS) -> DataFrame:
    """contig_num, total_len, n50, ng50, max_len, median_len over contigs of at least least bases.

    n50 is the first length, from the longest, at which the running sum exceeds half the total; ng50 the same against
    reference_length; the median is the element n div 2 of the descending order.
    """
    run = _by_length(contigs_, least)
    joined = run.crossJoin(totals := _totals(run))  # one row
    upto = F.col("longer") + F.col("len") * F.col("n")
    half = lambda c: F.max(F.when(upto > c, F.col("len")))
    found = joined.agg(half(F.expr("total_len div 2")).alias("n50"), half(F.lit(reference_length // 2)).alias("ng50"), F.max("len").alias("max_len"), F.max(F.when(F.col("before") + F.col("n") > F.expr("contig_num div 2"), F.col("len"))).alias("median_len"))
    return totals.crossJoin(found)


def nx_curve(contigs_: DataFrame, least: int = MIN_STATS, at: tuple[int, ...] = tuple(range(10, 100, 10))) -> DataFrame:
    """x, nx, lx: the first length, from the longest, at which the running sum exceeds x percent of the total (div 100), and
    how many contigs that takes; null where there are none. All x are found in one pass."""
    run = _by_length(contigs_, least)
    joined = run.crossJoin(_totals(run))  # one row
    joined = joined.select("*", *(F.expr(f"(total_len * {x}) div 100").alias(f"t{x}") for x in at))
    # within a length, as many contigs as it takes to get over what is left
    takes = lambda x: F.struct(F.col("len").alias("nx"), (F.col("before") + F.expr(f"(t{x} - longer) div len") + 1).alias("lx"))
    upto = F.col("longer") + F.col("len") * F.col("n")
    found = joined.agg(*(F.max_by(F.when(upto > F.col(f"t{x}"), takes(x)), F.when(upto > F.col(f"t{x}"), F.col("len"))).alias(f"f{x}") for x in at))
    rows = F.array(*(F.struct(F.lit(x).alias("x"), F.col(f"f{x}.nx").alias("nx"), F.col(f"f{x}.lx").alias("lx")) for x in at))
    return found.select(F.explode(rows).alias("r")).select("r.*")
