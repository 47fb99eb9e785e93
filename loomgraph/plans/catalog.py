"""The registered queries, over reads derived from documents at k=23 and cutoff 5.

The queries of single motif steps use k=19, at which all motifs occur; weak arcs are removed from the arcs of part names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import arcs as A
from loomgraph.operators import clean
from loomgraph.operators import contigs as C
from loomgraph.operators import sketches as Sk
from loomgraph.operators.compact import compact_reads
from loomgraph.plans import assembly, views
from loomgraph.plans.oracle import CUTOFF, MOTIF_K, ORACLE_SQL, PARTS_CUTOFF, K  # noqa: F401
from loomgraph.plans.session import shared_dir, stored
from loomgraph.sources import sinks
from loomgraph.sources.reads import documents, from_text, lines, spread
from loomgraph.streaming import counts as S

REFERENCE_LENGTH = 10_000


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, K)


def _spread(spark, sf_dir):
    return spread(_reads(spark, sf_dir))


def _counted(spark, sf_dir):
    return A.count_arcs(lines(spark, sf_dir), K)


def _unit(spark, sf_dir):
    return assembly.graph(lines(spark, sf_dir), K, CUTOFF)


def _compacted(spark, sf_dir):
    return compact_reads(lines(spark, sf_dir), K, CUTOFF)


def _histogram(spark, sf_dir):
    reads = lines(spark, sf_dir)
    return A.histogram(A.bins_of(reads, K), A.kmer_total(reads, K), spark)


def _streamed(spark, sf_dir):
    """The reads of documents, counted as a stream of the table's files."""
    documents_ = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # a pattern that fits the table alone, whether it is a file or a folder
    stream = spark.readStream.schema(documents_.schema).parquet(f"{sf_dir}/documents.parque[t]")
    folder = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    S.stream_counts(stream, K, f"{folder}/counts", f"{folder}/checkpoint")
    return S.counted_arcs(spark, f"{folder}/counts", K)


def _reloaded(spark, sf_dir):
    path = f"{shared_dir(spark).rstrip('/')}/graph-{uuid.uuid4().hex}"
    sinks.graph_lines(_compacted(spark, sf_dir)).write.text(path)
    return sinks.load_graph(spark, path, K)


def _sketched(spark, sf_dir):
    """Exact counts of the k-mers of each source, and whether those of the sketches are within the stated error."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    reads = spread(from_text(docs, "doc_id", "text", K, "source"))
    told = Sk.overlaps(stored(Sk.sketches(reads, "source", K), "sketches"), "source")
    each = stored(A.windows(reads, K, "source").distinct(), "kmers")
    exact = each.groupBy("source").agg(F.count("*").alias("exact")).crossJoin(F.broadcast(each.agg(F.count_distinct("w").alias("exact_all"))))  # one row
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= Sk.ERROR * F.col(b)
    met = told.join(exact, told["source"].eqNullSafe(exact["source"])).drop(exact["source"])
    return met.select("source", F.col("exact").alias("n_kmers"), F.col("exact_all").alias("n_all"), near("n_kmers", "exact").alias("near"), near("n_all", "exact_all").alias("all_near"))


def _asked(sql, upto, first=False):
    """A query in SQL alone, over the views of an assembly; first: it joins arcs0 with the first arcs of reads."""

    def run(spark, sf_dir):
        views.register(_spread(spark, sf_dir), K, CUTOFF, upto, lines(spark, sf_dir), first)
        return spark.sql(sql)

    return run


def _motifs(step):
    def run(spark, sf_dir):
        return step(compact_reads(lines(spark, sf_dir), MOTIF_K, CUTOFF), MOTIF_K)

    return run


def _weak(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("t"))
    reads = spread(from_text(parts, "p_partkey", "t", K))
    return _short(clean.remove_low_coverage(stored(assembly.graph(reads, K, PARTS_CUTOFF), "arcs"), K))


def _after(step):
    return lambda spark, sf_dir: step(_compacted(spark, sf_dir))


def _short(arcs: DataFrame) -> DataFrame:
    return arcs.select("src", "arc_idx", "mult")


QUERIES = {
    "reads_sanitized": _reads,
    "kmer_canonical_counts": lambda s, d: A.kmer_counts(_spread(s, d), K),
    "kmer_distinct": lambda s, d: A.kmer_counts(_spread(s, d), K).agg(F.count("*").alias("n_kmers"), F.sum("n").alias("n_occurrences")),
    "arc_multiplicity": _counted,
    "arc_histogram": _histogram,
    "arc_cutoff": lambda s, d: A.count_arcs(lines(s, d), K, CUTOFF),
    "node_degree_class": lambda s, d: A.degrees(_unit(s, d)),
    "semi_extended_nodes": lambda s, d: A.degrees(_unit(s, d)).where("degree_class = 'semi_extended'").select("src"),
    "graph_statistics": lambda s, d: A.graph_statistics(_unit(s, d), K),
    "neighbor_twin_join": lambda s, d: A.unit_twins(_unit(s, d)),
    "kmer_adjacency": lambda s, d: A.adjacency(_unit(s, d)),
    "unique_sides": lambda s, d: A.unique_sides(_unit(s, d)),
    "edge_list": lambda s, d: A.edge_list(_unit(s, d)),
    "partition_histogram": lambda s, d: A.partition_counts(lines(s, d), K, 24),
    "compacted_arcs": _compacted,
    "contigs": _after(lambda a: C.contigs(a, K)),
    "contig_stats": _after(lambda a: C.statistics(stored(C.contigs(a, K), "contigs"), REFERENCE_LENGTH)),
    "contig_numbers": _after(lambda a: C.numbered(C.contigs(a, K)).select("number", "name", "len", "offset")),
    "nx_curve": _after(lambda a: C.nx_curve(stored(C.contigs(a, K), "contigs"))),
    "graph_reloaded": _reloaded,
    "arcs_streamed": _streamed,
    "kmer_sketches": _sketched,
    "sql_arc_slots": _asked("SELECT arc_idx, count(*) AS n, sum(mult) AS total FROM arcs0 GROUP BY arc_idx", "arcs0"),
    "sql_first_arcs": _asked(
        f"""SELECT kmer, arc_idx, n, mult FROM (
          SELECT canonical(left(seq, {K})) AS kmer, arc_slot(substr(seq, {K + 1}, 1), left(seq, {K}) >= revcomp(left(seq, {K}))) AS arc_idx, count(*) AS n
          FROM reads WHERE length(seq) > {K} GROUP BY ALL) JOIN arcs0 USING (kmer, arc_idx)""", "arcs0", first=True),
    "sql_contig_ends": _asked(f"SELECT name, canonical(left(seq, {K})) AS first_kmer, canonical(right(seq, {K})) AS last_kmer, revcomp(seq) < seq AS turned FROM contigs", "contigs"),
    "tips_removed": lambda s, d: _short(clean.remove_tips(stored(_unit(s, d), "arcs"), K)),
    "low_coverage_removed": _weak,
    "master_statistics": _after(lambda a: A.master_statistics(a, K)),
    "parallel_edges": _after(clean.parallel_pairs),
    "bubble_pop": _motifs(clean.bubbles),
    "loop_unroll": _motifs(clean.unroll_loops),
    "repeat_linearise": _motifs(clean.linearise_repeats),
    "cross_edge": _motifs(clean.resolve_cross_edges),
    "cross_node": _motifs(clean.split_crossings),
    "assemble_full": lambda s, d: assembly.assemble(lines(s, d), K, CUTOFF),
}
