"""The whole assembly: reads to contigs."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import arcs as A
from loomgraph.operators import clean
from loomgraph.operators.compact import compact, compact_reads
from loomgraph.operators.contigs import contigs, longest_first, numbered, statistics
from loomgraph.plans.params import Params, parse
from loomgraph.plans.session import keep, scratch, shuffled_bytes, stored, stored_count, table_bytes
from loomgraph.sources import sinks
from loomgraph.sources.reads import contig_lengths, from_fasta, spread
from loomgraph.sources.sinks import load_graph

ROUNDS = 4


def graph(reads: DataFrame, k: int, cutoff: int) -> DataFrame:
    """Unit arcs that pass the cutoff."""
    return A.unit_arcs(reads, k, cutoff)


def _mark(arcs: DataFrame) -> tuple:
    """Tells two states of the arcs apart."""
    return tuple(arcs.agg(F.count("*"), F.sum(F.xxhash64("src", "arc_idx", "seq", "mult").cast("decimal(38,0)"))).first())


def clean_up(arcs: DataFrame, k: int, rounds: int = ROUNDS, split: bool = False) -> tuple[DataFrame, DataFrame]:
    """Stored tables of the arcs after error removal, and of the removed sequences; stops early when a round changes nothing."""
    spark = arcs.sparkSession
    removed = [spark.createDataFrame([], "seq string")]
    before = _mark(arcs)
    for _ in range(rounds):
        with scratch():
            arcs, popped = _round(arcs, k)
            removed += map(keep, popped)
            keep(arcs)
        if before == (before := _mark(arcs)):
            break
    with scratch():
        arcs = clean.until_stable(clean.resolve_cross_edges, arcs, k)
        if split:
            arcs = compact(clean.until_stable(clean.split_crossings, arcs, k), k)
        keep(arcs)
    return arcs, stored(reduce(DataFrame.union, removed), "removed")


def _round(arcs: DataFrame, k: int) -> tuple[DataFrame, list[DataFrame]]:
    """Stored tables of the arcs after a round, and of what each popping of bubbles removed."""
    arcs = compact(clean.remove_tips(arcs, k), k)
    arcs = compact(clean.remove_low_coverage(arcs, k), k)
    arcs = clean.until_stable(clean.unroll_loops, arcs, k)
    removed, n, m = [], -1, arcs.count()
    while n != m:
        arcs, popped = clean.pop_bubbles(arcs, k)
        n, (arcs, m) = m, stored_count(arcs, "popped")
        removed.append(stored(popped, "removed"))
    arcs = clean.until_stable(clean.linearise_repeats, arcs, k)
    return compact(arcs, k), removed


def assemble(reads: DataFrame, k: int, cutoff: int, split: bool = False) -> DataFrame:
    """Contigs of reads, after all error removal."""
    with scratch():
        arcs = keep(clean_up(compact_reads(reads, k, cutoff), k, split=split)[0])
    return contigs(arcs, k)


def contig_statistics(spark: SparkSession, path: str, reference_length: int) -> DataFrame:
    """One row of length statistics of a contig FASTA file."""
    return statistics(contig_lengths(spark, path), reference_length)


def main(spark: SparkSession, argv: list[str]) -> None:
    """Assembles FASTA reads, or a graph written before, into the output folder; metrics tell how it went.

    Rows are counted while tables are written; bytes are those of the tables, and those written to shuffles by each stage.
    """
    p: Params = parse(argv)
    with scratch():
        metrics = _run(spark, p)
    told = spark.createDataFrame(metrics, "stage string, seconds double, n_rows long, n_bytes long, n_shuffled long")
    told.coalesce(1).write.json(f"{p.output}/metrics")


def _run(spark: SparkSession, p: Params) -> list[tuple]:
    metrics, began, moved = [], time.time(), shuffled_bytes(spark)

    def ended(stage: str, n: int | None = None, table: DataFrame | None = None) -> None:
        nonlocal began, moved
        now = shuffled_bytes(spark)
        metrics.append((stage, round(time.time() - began, 3), n, table_bytes(table) if table is not None else None, now - moved))
        began, moved = time.time(), now

    if p.resume:
        arcs = load_graph(spark, p.resume, p.k)
        ended("graph loaded", arcs.count(), arcs)
    else:
        reads = spread(from_fasta(spark, p.input, p.k))
        counted, n = stored_count(A.count_arcs(reads, p.k), "counted")
        ended("arcs counted", n, counted)
        sinks.write_histogram(A.histogram(A.bins(counted), A.kmer_total(reads, p.k), spark), f"{p.output}/arcFrequency.txt")
        ended("arc frequencies")
        arcs = A.as_arcs(A.cutoff(counted, p.cutoff), p.k)
        if p.kmer_graph:
            sinks.adjacency_lines(A.adjacency(arcs)).write.text(f"{p.output}/kmerGraph.txt")
            ended("k-mer graph")
            return metrics
        arcs = compact(arcs, p.k)
        ended("compacted", arcs.count(), arcs)
    sinks.write_fasta(contigs(arcs, p.k), f"{p.output}/noCEcontigs.fasta")
    if p.contig_graph and not p.performance:
        sinks.graph_lines(arcs).write.text(f"{p.output}/contigGraph.txt")
    ended("contigs before error removal")
    if not p.performance:
        arcs, removed = clean_up(arcs, p.k, split=p.split)
        ended("error removal", arcs.count(), arcs)
        found = numbered(contigs(arcs, p.k)).select("name", "seq").unionByName(sinks.removed_contigs(removed))
        sinks.write_fasta(longest_first(found), f"{p.output}/CEContig.fasta")
        if p.edge_list:
            edges = A.edge_list(arcs)
            sinks.edge_lines(edges, "len").write.text(f"{p.output}/JungGraph_arc.txt")
            sinks.edge_lines(edges, "mult").write.text(f"{p.output}/JungGraph_mul.txt")
        ended("contigs")
    return metrics
