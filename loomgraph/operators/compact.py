"""Contraction of non-branching paths by list ranking.

A node is passed through if it has one arc on each side and is no neighbour of itself. Every arc out of such a node has
exactly one arc before it; pointers to those are doubled until they reach an arc out of a node that stays. What never does is
a cycle: its largest k-mer stays, and its arcs are ranked again. A round reads and writes the open arcs, and looks up those
that are done; ids are longs. Strings are joined at the end, as the parts of a path come to a task in their order, so that
the data stay linear. cov is summed exactly and mult is cov div
len, so that an arc and its twin always agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.kmers import arc_slot, canonical, is_canonical, oriented, reverse_complement
from loomgraph.operators import packed
from loomgraph.operators.arcs import SATURATION, as_arcs, unit_arcs
from loomgraph.plans.session import keep, scratch, stored, stored_count

#: Open links that one task ranks, at some 100 bytes each.
ONE_TASK = 1 << 21
#: Rounds after which arcs that have ended are picked out anew.
PICK = 3


def survivors(arcs: DataFrame) -> DataFrame:
    """src of nodes that stay."""
    node = arcs.groupBy("src").agg(F.count_if(F.col("arc_idx") < 4).alias("r"), F.count_if(F.col("arc_idx") >= 4).alias("l"), F.count_if(F.col("dst") == F.col("src")).alias("own"))
    return node.where((F.col("r") != 1) | (F.col("l") != 1) | (F.col("own") > 0)).select("src")


def _in_one_task(open_: DataFrame, live: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """id, head, dist of what reaches a head, and id of what runs in circles, of so few open links that one task ranks them.

    open_: id, ptr, dist; live: id, head, dist of the ended arcs that they point to; without it, what they point to and is
    not among them is a head.
    """
    both = open_.select("id", "ptr", "dist", F.lit(None).cast("long").alias("head"))
    if live is not None:
        both = both.unionByName(live.select("id", F.lit(None).cast("long").alias("ptr"), "dist", "head"))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]
        if not found:
            return
        id_, ptr, dist, head = (np.concatenate([b.column(i).fill_null(-1).to_numpy() for b in found]) for i in range(4))
        order = np.argsort(id_)
        id_, ptr, dist, head = (x[order] for x in (id_, ptr, dist, head))
        at = np.minimum(np.searchsorted(id_, ptr), len(id_) - 1)
        known, own = id_[at] == ptr, np.arange(len(id_))
        ended = head >= 0
        # an open row whose pointer leads out of the table ends at a head; all that have ended point to themselves, 0 away
        head = np.where(ended, head, np.where(known, -1, ptr))
        total, step = dist.copy(), np.where(ended | ~known, 0, dist)
        base = np.where(ended | ~known, total, 0)
        at = np.where(head >= 0, own, at)
        for _ in range(len(id_).bit_length()):
            if (head[at] >= 0).all():
                break
            step, at = step + step[at], at[at]
        out = ~ended
        head, dist = head[at][out], (step + base[at])[out]
        id_ = id_[out]
        for i in range(0, len(id_), 1 << 18):
            h = head[i : i + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(id_[i : i + (1 << 18)]), pa.array(h, mask=h < 0), pa.array(dist[i : i + (1 << 18)])], ["id", "head", "dist"])

    ranked = stored(both.coalesce(1).mapInArrow(rank, "id long, head long, dist long"), "ranked")
    return ranked.where("head IS NOT NULL"), ranked.where("head IS NULL").select("id")


def _rank(heads: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """id, head, dist of all arcs that reach a head; id of those that run in circles; and the links as stored.

    heads: id; links: id, ptr (the arc before), dist (the bases of that). Rounds go on until one task can rank what is open.
    """
    first, n = stored_count(links, "links")
    open_ = first
    if n <= ONE_TASK:
        done, cycles = _in_one_task(open_, None)
        return heads.select("id", F.col("id").alias("head"), F.lit(0).cast("long").alias("dist")).unionByName(done), cycles, first
    ended = heads.select("id", F.col("id").alias("head"), F.lit(0).cast("long").alias("dist"))
    # of what has ended, only what an open arc points to is looked up, so that rounds cost as much as there are open arcs; it
    # is picked out every few rounds, as a round leaves at most half of a chain open
    sought = lambda done: done.join(open_.select(F.col("ptr").alias("id")).distinct(), "id", "left_semi")
    live, turn = sought(ended), 0
    while n:
        ahead = live.select(F.col("id").alias("ptr"), F.lit(None).cast("long").alias("next"), F.col("dist").alias("_d"), "head")
        ahead = ahead.unionByName(open_.select(F.col("id").alias("ptr"), F.col("ptr").alias("next"), F.col("dist").alias("_d"), F.lit(None).cast("long").alias("head")))
        before = n
        moved, n = stored_count(open_.join(ahead, "ptr").select("id", "next", (F.col("dist") + F.col("_d")).alias("dist"), "head"), "rank", "head IS NULL")
        if n == before:
            break  # chains get shorter in every round, so only cycles are left
        done = moved.where(F.col("head").isNotNull()).select("id", "head", "dist")
        ended, open_ = ended.unionByName(done), moved.where(F.col("head").isNull()).select("id", F.col("next").alias("ptr"), "dist")
        live, turn = live.unionByName(done), turn + 1
        if n <= ONE_TASK:
            done, cycles = _in_one_task(open_, sought(live))
            return ended.unionByName(done), cycles, first
        if n and turn % PICK == 0:
            live = stored(sought(live), "live")
    return ended, open_.select("id"), first


def _tops(rest: DataFrame) -> DataFrame:
    """id, top: the largest k-mer of the cycle of each arc. rest: id, ptr, src."""
    state = stored(rest.select("id", "ptr", F.col("src").alias("top")), "cycle")
    while True:
        ahead = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("top").alias("_top"))
        moved = state.join(ahead, "ptr").select("id", F.col("_ptr").alias("ptr"), F.greatest("top", "_top").alias("top"), (F.col("_top") > F.col("top")).alias("grew"))
        state, grew = stored_count(moved, "cycle", "grew")
        if not grew:
            return state.select("id", "top")


def _with_mult(paths: DataFrame) -> DataFrame:
    return paths.select("src", "arc_idx", "seq", "len", "cov", F.expr("cov div len").alias("mult"), "dst", "dst_pos")


def joined(order: str, string: str) -> Column:
    """seq: the strings of a group, in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, string))), lambda x: x[string]), "").alias("seq")


def compact(arcs: DataFrame, k: int) -> DataFrame:
    """A stored table of the arcs between the nodes that stay, each following a whole path."""
    with scratch():
        return keep(stored(_compacted(arcs), "compacted"))


def compact_reads(reads: DataFrame, k: int, cutoff: int) -> DataFrame:
    """compact() of the unit arcs of reads that pass the cutoff.

    Runs of up to 32 bases never become rows of their own: stretches of them are joined where nodes with one minimizer meet,
    and only the stretches are ranked.
    """
    if not packed.fits(k + 1):
        return compact(unit_arcs(reads, k, cutoff), k)
    with scratch():
        return keep(stored(_of_stretches(packed.contracted(packed.runs_by_end(packed.pieces(reads, k + 1), k + 1, cutoff, SATURATION), k + 1), k), "compacted"))


def _of_stretches(stretches: DataFrame, k: int) -> DataFrame:
    named = stored(stretches.withColumn("id", F.monotonically_increasing_id()), "stretches")
    into = named.select(F.col("end").alias("start"), F.col("id").alias("ptr"), F.col("len").alias("dist"))
    passed = named.where(~F.col("stays")).select("id", "start").join(into, "start").select("id", "ptr", "dist")
    ranked, cycles, _ = _rank(named.where("stays").select("id"), passed)
    out = _with_mult(_paths(named.join(ranked, "id")))
    return out if cycles.isEmpty() else out.unionByName(_compacted(_unit_arcs(named.join(cycles, "id", "left_semi"), k)))


def _unit_arcs(stretches: DataFrame, k: int) -> DataFrame:
    """The arcs that stretches are made of."""
    whole = stretches.select(F.concat(oriented(F.col("src"), F.col("arc_idx")), "seq").alias("s"), "mults", F.explode(F.sequence(F.lit(1), F.col("len").cast("int"))).alias("i"))
    first, base, mult = F.substring(F.col("s"), F.col("i"), F.lit(k)), F.substring(F.col("s"), F.col("i") + k, F.lit(1)), F.conv(F.hex(F.substring(F.col("mults"), F.col("i"), F.lit(1))), 16, 10).cast("long")
    return as_arcs(whole.select(canonical(first).alias("kmer"), arc_slot(base, is_canonical(first)).alias("arc_idx"), mult.alias("mult")), k)


def _paths(parts: DataFrame) -> DataFrame:
    """src, arc_idx, seq, len, cov, dst, dst_pos of paths, from their parts with head and dist.

    A path's parts come in their order, so that its string stands in one piece in the buffer of theirs.
    """
    own = parts.select("head", "dist", "src", "arc_idx", "seq", "len", "cov", "dst", "dst_pos")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None  # parts of the last path, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            head = batch.column(0).to_numpy()
            cuts = np.flatnonzero(head[1:] != head[:-1]) + 1
            if open_ and open_[-1].column(0)[0] != batch.column(0)[0]:
                yield _joined(pa.concat_batches(open_))
                open_ = None
            if open_ and not len(cuts):
                open_.append(batch)
                continue
            at = int(cuts[-1]) if len(cuts) else 0
            if open_:
                yield _joined(pa.concat_batches([*open_, batch.slice(0, int(cuts[0]))]))
            done = batch.slice(int(cuts[0]) if open_ else 0, at - (int(cuts[0]) if open_ else 0))
            if done.num_rows:
                yield _joined(done)
            open_ = [batch.slice(at)]
        if open_:
            yield _joined(pa.concat_batches(open_))

    return own.repartition("head").sortWithinPartitions("head", "dist").mapInArrow(join, "src string, arc_idx int, seq string, len long, cov long, dst string, dst_pos boolean")


def _joined(parts: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each head, whose parts stand together."""
    head = parts.column("head").to_numpy()
    first = np.flatnonzero(np.append(True, head[1:] != head[:-1]))
    last = np.append(first[1:], len(head)) - 1
    seq = parts.column("seq").cast(pa.large_string())
    ends = np.frombuffer(seq.buffers()[1], np.int64)[seq.offset : seq.offset + len(seq) + 1]
    data = seq.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0]))
    whole = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer((ends[np.append(first, len(head))] - ends[0]).astype(np.int32)), data])
    sums = {c: pa.array(np.add.reduceat(parts.column(c).to_numpy(), first)) for c in ("len", "cov")}
    columns = {c: parts.column(c).take(pa.array(first)) for c in ("src", "arc_idx")} | {"seq": whole} | sums | {c: parts.column(c).take(pa.array(last)) for c in ("dst", "dst_pos")}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _compacted(arcs: DataFrame) -> DataFrame:
    arcs = stored(arcs.withColumn("id", F.monotonically_increasing_id()), "arcs")
    stays = survivors(arcs).withColumn("stays", F.lit(True))
    end = F.when(F.col("dst_pos"), F.col("dst")).otherwise(reverse_complement(F.col("dst")))
    named = stored(arcs.join(stays, "src", "left").withColumns({"os": oriented(F.col("src"), F.col("arc_idx")), "od": end}), "named")
    into = named.select(F.col("od").alias("os"), F.col("id").alias("ptr"), F.col("len").alias("dist"))
    passed = named.where(F.col("stays").isNull()).select("id", "os").join(into, "os").select("id", "ptr", "dist")
    ranked, cycles, links = _rank(named.where(F.col("stays")).select("id"), passed)
    if not cycles.isEmpty():
        rest = links.join(cycles, "id").join(named.select("id", "src"), "id")
        again = stored(rest.join(_tops(rest), "id"), "cycles")
        start = F.col("src") == F.col("top")
        more, _, _ = _rank(again.where(start).select("id"), again.where(~start).select("id", "ptr", "dist"))
        ranked = ranked.unionByName(more)
    return _with_mult(_paths(named.join(ranked, "id")))
