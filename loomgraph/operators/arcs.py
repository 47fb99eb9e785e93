"""K-mers and arcs: extraction, counts, cutoff, degrees, statistics and neighbours.

arcs: src, arc_idx, seq, len, cov, mult, dst, dst_pos. src and dst are canonical k-mers; dst_pos says whether the arc arrives
at dst as it is written. Every arc has a twin that leads back.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.kmers import arc_slot, canonical, code, oriented, partition_hash, reverse_complement, text_to_bases
from loomgraph.operators import packed
from loomgraph.plans.session import stored

SATURATION = 255


#: The last bin of the histogram, of this multiplicity and more.
TOP_BIN = 250
#: Windows that are cut from one piece of a read.
PIECE = 1024


def windows(reads: DataFrame, size: int, *carry: str) -> DataFrame:
    """w binary: the larger strand of every window of size bases of the reads that are long enough; and the columns to carry.

    Reads are cut into overlapping pieces first, and windows are cut from a piece's bytes and from those of its reverse
    complement, so that the cost of a window does not depend on the length of its read and no window is complemented by
    itself.
    """
    long_enough = reads.where(F.length("seq") >= size)
    piece = F.explode(F.sequence(F.lit(1), F.length("seq") - size + 1, F.lit(PIECE)))
    pieces = long_enough.select("seq", *carry, piece.alias("at")).select(*carry, F.substring(F.col("seq"), F.col("at"), F.lit(PIECE + size - 1)).alias("s"))
    strands = pieces.select(*carry, F.col("s").cast("binary").alias("f"), reverse_complement(F.col("s")).cast("binary").alias("r"), (F.length("s") - size).alias("last"))
    at = strands.select(*carry, "f", "r", "last", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("i"))
    forth, back = F.substring(F.col("f"), F.col("i") + 1, F.lit(size)), F.substring(F.col("r"), F.col("last") - F.col("i") + 1, F.lit(size))
    return at.select(*carry, F.greatest(forth, back).alias("w"))


def kmer_counts(reads: DataFrame, k: int) -> DataFrame:
    return windows(reads, k).groupBy("w").agg(F.count("*").alias("n")).select(F.col("w").cast("string").alias("kmer"), "n")


def partition_counts(reads: DataFrame, k: int, parts: int) -> DataFrame:
    """part, n: how many of the reads' k-mers go to each of so many partitions."""
    if not packed.fits(k):
        return kmer_counts(bases(reads), k).groupBy((partition_hash(F.col("kmer")) % parts).alias("part")).agg(F.count("*").alias("n"))

    def finish(codes, times):
        n = np.bincount(packed.partition_hashes(codes, k) % parts)
        return {"part": np.flatnonzero(n), "n": n[n > 0]}

    return packed.tallied(packed.pieces(reads, k), k, finish, "part long, n long").groupBy("part").agg(F.sum("n").alias("n"))


def bases(reads: DataFrame) -> DataFrame:
    """reads, or those that the lines of a column text stand for."""
    return reads if "seq" in reads.columns else reads.select(F.explode(F.split("text", "\n")).alias("t")).select(text_to_bases(F.col("t")).alias("seq"))


def count_arcs(reads: DataFrame, k: int, least: int = 1) -> DataFrame:
    """kmer, arc_idx, mult (at most 255) of arcs seen least times. reads have a column seq, or text as bases() takes it.

    An arc is a run of k+1 bases, seen from either strand. Counting the larger strand of each run halves the shuffle, and
    both of its arcs follow by projection: no two runs give the same arc. Runs of up to 32 bases are counted as numbers.
    """
    if packed.fits(k + 1):
        return arcs_in(packed.pieces(reads, k + 1), k, least)
    return cutoff(arcs_of(windows(bases(reads), k + 1).groupBy("w").agg(F.count("*").alias("n")), k), least)


def arcs_in(pieces: DataFrame, k: int, least: int = 1) -> DataFrame:
    """count_arcs() of reads that are cut into pieces."""

    def finish(codes, times):
        found = packed.arcs(codes, times, k + 1, least, SATURATION)
        return {"kmer": packed.spelled(found["src"], k), "arc_idx": found["arc_idx"], "mult": found["mult"]}

    return packed.tallied(pieces, k + 1, finish, "kmer string, arc_idx int, mult long")


def first_arcs(reads: DataFrame, k: int) -> DataFrame:
    """count_arcs(), of the runs that reads begin with only; what is counted is still the whole of the reads.

    Those runs meet the others where they are counted, so that neither the arcs nor the reads are shuffled for it.
    """
    if not packed.fits(k + 1):
        seqs = bases(reads).where(F.length("seq") > k).select(F.left("seq", F.lit(k + 1)).alias("seq")).distinct()
        return count_arcs(reads, k).join(count_arcs(seqs, k).select("kmer", "arc_idx"), ["kmer", "arc_idx"], "left_semi")

    def finish(codes, times):
        asked = times >= packed.ASKED
        found = packed.arcs(codes[asked], times[asked] % packed.ASKED, k + 1, 1, SATURATION)
        return {"kmer": packed.spelled(found["src"], k), "arc_idx": found["arc_idx"], "mult": found["mult"]}

    both = packed.pieces(reads, k + 1).union(packed.pieces(reads, k + 1, True))
    return packed.tallied(both, k + 1, finish, "kmer string, arc_idx int, mult long")


def unit_arcs(reads: DataFrame, k: int, least: int) -> DataFrame:
    """Unit arcs with their ends, of runs that are seen least times."""
    if not packed.fits(k + 1):
        return as_arcs(count_arcs(reads, k, least), k)

    def finish(codes, times):
        found = packed.arcs(codes, times, k + 1, least, SATURATION)
        slot, mult, end = found["arc_idx"], found["mult"], found["end"]
        dst = packed.larger(end, k)
        one = packed.ones(len(mult))
        return {"src": packed.spelled(found["src"], k), "arc_idx": slot, "seq": packed.spelled(packed.base(slot), 1), "len": one, "cov": mult, "mult": mult, "dst": packed.spelled(dst, k), "dst_pos": end == dst}

    return packed.tallied(packed.pieces(reads, k + 1), k + 1, finish, "src string, arc_idx int, seq string, len long, cov long, mult long, dst string, dst_pos boolean")


def arcs_of(runs: DataFrame, k: int) -> DataFrame:
    """kmer, arc_idx, mult of counted runs (w binary, the larger strand; n). One that is its own reverse complement is one arc, counted twice."""
    runs = runs.select(F.col("w").cast("string").alias("e"), "n")
    runs = runs.select("e", reverse_complement(F.col("e")).alias("o"), "n")
    own = F.col("e") == F.col("o")

    def arc(a: str, b: str) -> Column:
        """The arc that leaves the first k bases of a; b is its reverse complement."""
        start, other = F.substring(F.col(a), 1, k), F.substring(F.col(b), 2, k)
        times = F.when(own, 2 * F.col("n")).otherwise(F.col("n"))
        return F.struct(F.greatest(start, other).alias("kmer"), arc_slot(F.right(a, F.lit(1)), start >= other).alias("arc_idx"), F.least(times, F.lit(SATURATION)).cast("long").alias("mult"))

    return runs.select(F.explode(F.when(own, F.array(arc("e", "o"))).otherwise(F.array(arc("e", "o"), arc("o", "e")))).alias("x")).select("x.*")


def kmer_total(reads: DataFrame, k: int) -> DataFrame:
    """One row n_kmers: how many k-mers the reads have."""
    if not packed.fits(k):
        return windows(bases(reads), k).distinct().agg(F.count("*").alias("n_kmers"))
    each = packed.tallied(packed.pieces(reads, k), k, lambda codes, times: {"n": np.array([len(codes)], np.int64)}, "n long")
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_kmers"))


def bins(arcs0: DataFrame) -> DataFrame:
    """mult_bin and n of arcs0; 250 stands for 250 and more."""
    return arcs0.groupBy(F.least("mult", F.lit(TOP_BIN)).cast("long").alias("mult_bin")).agg(F.count("*").alias("n"))


def bins_of(reads: DataFrame, k: int) -> DataFrame:
    """bins() of the arcs of reads, of which no row is made where runs are counted as numbers."""
    if not packed.fits(k + 1):
        return bins(count_arcs(reads, k))

    def finish(codes, times):
        n = packed.bins(codes, times, k + 1, TOP_BIN)
        return {"mult_bin": np.flatnonzero(n), "n": n[n > 0]}

    return packed.tallied(packed.pieces(reads, k + 1), k + 1, finish, "mult_bin long, n long").groupBy("mult_bin").agg(F.sum("n").alias("n"))


def histogram(bins: DataFrame, n_kmers: DataFrame, spark) -> DataFrame:
    """mult_bin 0 to 999 and n over all eight slots of all k-mers (one row n_kmers), from bins()."""
    bins = stored(bins, "bins")  # read twice
    used = bins.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("used"))
    zero = n_kmers.crossJoin(used).select(F.lit(0).cast("long").alias("mult_bin"), (8 * F.col("n_kmers") - F.col("used")).alias("n"))
    every = spark.range(1000).select(F.col("id").alias("mult_bin"))
    return every.join(bins.union(zero), "mult_bin", "left").select("mult_bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cutoff(arcs0: DataFrame, least: int) -> DataFrame:
    return arcs0.where(F.col("mult") >= least)


def end_of(src: Column, slot: Column, seq: Column, k: int) -> Column:
    return F.right(F.concat(oriented(src, slot), seq), F.lit(k))


def as_arcs(counted: DataFrame, k: int) -> DataFrame:
    """Unit arcs with their ends, from kmer, arc_idx, mult."""
    base = F.substring(F.lit("ACGT"), F.col("arc_idx") % 4 + 1, F.lit(1))
    a = counted.select(F.col("kmer").alias("src"), "arc_idx", base.alias("seq"), F.lit(1).cast("long").alias("len"), F.col("mult").alias("cov"), "mult")
    return with_ends(a, k)


def with_ends(arcs: DataFrame, k: int) -> DataFrame:
    end = end_of(F.col("src"), F.col("arc_idx"), F.col("seq"), k)
    return arcs.withColumn("_end", end).withColumn("dst", canonical(F.col("_end"))).withColumn("dst_pos", F.col("_end") == F.col("dst")).drop("_end")


def degrees(arcs: DataFrame) -> DataFrame:
    """src, right_degree (slots 0 to 3), left_degree (4 to 7), degree_class."""
    d = arcs.groupBy("src").agg(F.count_if(F.col("arc_idx") < 4).alias("right_degree"), F.count_if(F.col("arc_idx") >= 4).alias("left_degree"))
    total = F.col("right_degree") + F.col("left_degree")
    kind = F.when((F.col("right_degree") == 1) & (F.col("left_degree") == 1), "semi_extended").when(total == 1, "end").when(total > 2, "branch").otherwise("other")
    return d.withColumn("degree_class", kind)


def graph_statistics(arcs: DataFrame, k: int) -> DataFrame:
    """node_num, edge_num, arc_length_sum, tips_num, bubble_num."""
    first = lambda f: f(F.struct("seq", "len", "mult"), F.struct("mult", "arc_idx") if f is F.min_by else F.struct("mult", -F.col("arc_idx")))
    node = arcs.groupBy("src").agg(F.count("*").alias("degree"), F.max("len").alias("longest"), F.sum("len").alias("total"), first(F.min_by).alias("low"), F.max("mult").alias("high"))
    return node.agg(
        F.count("*").alias("node_num"),
        F.coalesce(F.sum("degree"), F.lit(0)).cast("long").alias("edge_num"),
        F.coalesce(F.sum("total"), F.lit(0)).cast("long").alias("arc_length_sum"),
        F.count_if((F.col("degree") == 1) & (F.col("longest") < k)).alias("tips_num"),
        F.count_if((F.col("low.mult") * 5 < F.col("high")) & (F.col("low.len") < 2 * k)).alias("bubble_num"),
    )


def _digest(string: Column) -> list[Column]:
    """Two longs that stand for a string of any length in joins: two independent 64-bit hashes."""
    return [F.xxhash64(string).alias("h1"), F.xxhash64(F.lit(1), string).alias("h2")]


def _side(slot: Column, name: str) -> Column:
    return F.when(slot < 4, 0).otherwise(1).alias(name)


def twins(arcs: DataFrame, k: int, of: DataFrame | None = None) -> DataFrame:
    """src, arc_idx, t_src, t_idx: each arc (of those in of) with the first arc that leads back along the same string.

    The two are found by node, side, length and 128 bits of hashes of their strings: no string is shuffled.
    """
    back = F.substring(reverse_complement(F.concat(oriented(F.col("src"), F.col("arc_idx")), F.col("seq"))), k + 1, 1 << 30)
    some = arcs if of is None else arcs.join(of.select("src", "arc_idx").distinct(), ["src", "arc_idx"], "left_semi")
    asked = some.select("src", "arc_idx", F.col("dst").alias("t_src"), F.when(F.col("dst_pos"), 1).otherwise(0).alias("t_side"), "len", *_digest(back))
    there = arcs.select(F.col("src").alias("t_src"), _side(F.col("arc_idx"), "t_side"), "len", *_digest(F.col("seq")), F.col("arc_idx").alias("t_idx"))
    return asked.join(there, ["t_src", "t_side", "len", "h1", "h2"]).groupBy("src", "arc_idx", "t_src").agg(F.min("t_idx").alias("t_idx"))


def unit_twins(arcs: DataFrame) -> DataFrame:
    """src, arc_idx, t_src, t_idx of unit arcs: a projection, as the base before the last k names the twin's slot.

    Both arcs of a run are counted together, so that neither passes a cutoff without the other.
    """
    start = F.left(oriented(F.col("src"), F.col("arc_idx")), F.lit(1))
    slot = 3 - code(start) + F.when(F.col("dst_pos"), 4).otherwise(0)
    return arcs.select("src", "arc_idx", F.col("dst").alias("t_src"), slot.cast("int").alias("t_idx"))


def coverage(arcs: DataFrame) -> DataFrame:
    """One row avg_coverage: sum(len * mult) div sum(len), 0 where there is nothing."""
    return arcs.agg(F.coalesce(F.expr("sum(len * mult) div sum(len)"), F.lit(0)).cast("long").alias("avg_coverage"))


def master_statistics(arcs: DataFrame, k: int) -> DataFrame:
    """avg_coverage, node_num, tip_num, loop_num, multiple_edge_num, resolvable_num, cross_num."""
    node = arcs.groupBy("src").agg(F.count("*").alias("degree"), F.max("len").alias("longest"), F.count_if(F.col("arc_idx") < 4).alias("r"), F.count_if(F.col("dst") == F.col("src")).alias("loops"))
    per = node.agg(
        F.count("*").alias("node_num"), F.count_if((F.col("degree") == 1) & (F.col("longest") < k)).alias("tip_num"),
        F.coalesce(F.sum("loops"), F.lit(0)).cast("long").alias("loop_num"), F.count_if(F.col("r") * 2 == F.col("degree")).alias("cross_num"),
    )
    together = arcs.groupBy("src", "dst").agg(F.count("*").alias("n"))
    pairs = together.where(F.col("n") > 1).join(node.select("src", F.col("degree").alias("d1")), "src").join(node.select(F.col("src").alias("dst"), F.col("degree").alias("d2")), "dst")
    multi = pairs.agg(
        F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).cast("long").alias("multiple_edge_num"),
        F.coalesce(F.sum(F.when((F.col("d1") == 3) & (F.col("d2") == 3), F.expr("n * (n - 1) div 2"))), F.lit(0)).cast("long").alias("resolvable_num"),
    )
    return coverage(arcs).crossJoin(per).crossJoin(multi)  # one row each


def adjacency(arcs: DataFrame) -> DataFrame:
    """src, right_next and left_next: the neighbours on either side, sorted and joined with blanks."""
    side = lambda at: F.array_join(F.array_sort(F.collect_list(F.when(at, F.col("dst")))), " ")
    return arcs.groupBy("src").agg(side(F.col("arc_idx") < 4).alias("right_next"), side(F.col("arc_idx") >= 4).alias("left_next"))


def unique_sides(arcs: DataFrame) -> DataFrame:
    """src, and for either side the string, multiplicity and neighbour of its arc, null unless there is just one."""
    sides = {"right": F.col("arc_idx") < 4, "left": F.col("arc_idx") >= 4}
    return arcs.groupBy("src").agg(*(F.when(F.count_if(at) == 1, F.max(F.when(at, F.col(c)))).alias(f"{side}_{c}") for side, at in sides.items() for c in ("seq", "mult", "dst")))


def edge_list(arcs: DataFrame) -> DataFrame:
    return arcs.select("src", "arc_idx", "dst", "len", "mult")
