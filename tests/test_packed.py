"""Counts by minimizers and stretches of arcs, against plain Python and against the compaction of single arcs."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomgraph.functions import kmers as K
from loomgraph.operators import arcs as A
from loomgraph.operators import compact as C
from loomgraph.operators import packed as P
from loomgraph.plans.assembly import graph
from loomgraph.plans.session import shuffled_bytes


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def some_reads(rng, size):
    seqs = ["".join(rng.choices("ACGT", k=rng.choice([0, 3, size - 1, size, size + 1, 70, 400]))) for _ in range(60)]
    return seqs + ["A" * 300, "AC" * 200, ""] + seqs[:20]


def in_order(rows):
    found = pa.Table.from_batches(rows)
    return found.take(np.argsort(found["bucket"].to_numpy(), kind="stable")).combine_chunks().to_batches(max_chunksize=17)


@pytest.mark.parametrize("size", [4, 5, 20, 24, 31, 32])
@pytest.mark.parametrize(("passed", "held"), [(1 << 22, 1 << 21), (97, 1 << 21), (97, 40)])
def test_windows_are_counted_whatever_is_held_at_a_time(monkeypatch, size, passed, held):
    for name, n in (("CHUNK", 500), ("PASS", passed), ("HELD", held), ("TOGETHER", min(passed, 1 << 18))):
        monkeypatch.setattr(P, name, n)
    seqs = some_reads(random.Random(size), size)
    want = Counter(max(w, rc(w)) for s in seqs for w in (s[i : i + size] for i in range(len(s) - size + 1)))
    rows = [P._rows_of_pieces(*p) for i in range(0, len(seqs), 7) for p in P._cut(*P._joined_codes([pa.array(seqs[i : i + 4], pa.string()), pa.array(seqs[i + 4 : i + 7], pa.string())], "seq"), size)]

    def counted(batches):
        got = Counter()
        for parts, n in P._groups(P._buckets(batches, size)):
            for codes, times in P._tallies(parts, n, size):
                for w, t in zip(P.spelled(codes, size).to_pylist(), times, strict=True):
                    assert w not in got
                    got[w] += int(t)
        return got

    assert counted(in_order(rows)) == want
    merged = []
    for bucket, parts, _ in P._buckets(in_order(rows), size):
        lens, data, times = P._as_one(parts, size)[0]
        merged.append(P._rows_of_pieces(np.full(len(lens), bucket, np.uint16), lens, data, P._room(lens, size), times))
    assert counted(in_order(merged)) == want and sum(len(b.column(2)) for b in merged) <= sum(len(b.column(2)) for b in rows)


def test_lines_of_text_are_counted_as_their_reads(spark):
    texts = ["abc défg\nxyzXYZ-0123456789 the quick brown fox", "", None, "née\r\nthe quick brown fox jumps over\n", "日本語 the quick brown fox 🦊 the quick brown fox"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    seqs = A.bases(docs.select("text"))
    for k in (5, 23, 33):
        got = sorted(map(tuple, A.count_arcs(docs.select("text"), k).collect()))
        assert got == sorted(map(tuple, A.arcs_of(A.windows(seqs, k + 1).groupBy("w").count().withColumnRenamed("count", "n"), k).collect()))


def test_counts_shuffle_few_bytes_a_base(spark):
    rng = random.Random(3)
    reads = spark.createDataFrame([(str(i), "".join(rng.choices("ACGT", k=5000))) for i in range(200)], "read_id string, seq string")
    before = shuffled_bytes(spark)
    A.bins_of(reads, 23).collect()
    A.kmer_total(reads, 23).collect()
    A.partition_counts(reads, 23, 24).collect()
    assert shuffled_bytes(spark) - before < 3 * 3 * 1_000_000  # as strings, over 20 bytes a base for each of the three


def test_partitions_by_number_are_those_by_string(spark):
    codes = np.random.default_rng(1).integers(0, 4**23, 200).astype(np.uint64)
    kmers = P.spelled(codes, 23).to_pylist()
    want = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(kmers)], "i int, x string").orderBy("i").select(K.partition_hash("x")).collect()]
    assert P.partition_hashes(codes, 23).tolist() == want


def walks(rng, k):
    dna = lambda n: "".join(rng.choices("ACGT", k=n))
    g, ring, other = dna(400), dna(70), dna(90)
    return [g, g[100:200] + dna(60), dna(30) + g[250:330], ring + ring[:k], rc(other + other[:k]), "A" * 60, g[:50] + rc(g[:50]), "ACACACACGTGTGTG" * 4] + [dna(100) for _ in range(10)]


@pytest.mark.parametrize(("k", "one_task"), [(21, 1 << 21), (21, 20), (5, 1 << 21)])
def test_stretches_compact_as_single_arcs_do(spark, monkeypatch, k, one_task):
    monkeypatch.setattr(C, "ONE_TASK", one_task)
    reads = spark.createDataFrame([(str(i), s) for i, s in enumerate(walks(random.Random(k), k))], "read_id string, seq string").repartition(3)
    columns = ["src", "arc_idx", "seq", "len", "cov", "mult", "dst", "dst_pos"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    found = rows(C.compact_reads(reads, k, 1))
    assert found == rows(C.compact(graph(reads, k, 1), k)) and any(r[0] == r[6] for r in found)


@pytest.mark.parametrize("n_nodes", [1, 7, 1 << 19])
def test_each_arc_is_in_one_stretch(monkeypatch, n_nodes):
    """However few buckets meet, stretches have each arc once, go on where they say, and stop at all nodes that stay."""
    monkeypatch.setattr(P, "NODES", n_nodes)
    k = 21
    seqs = walks(random.Random(9), k)
    runs = Counter(max(w, rc(w)) for s in seqs for w in (s[i : i + k + 1] for i in range(len(s) - k)))
    code = lambda s: int(s.translate(str.maketrans("ACGT", "0123")), 4)
    codes = np.array([code(w) for w in runs], np.uint64)
    ends = [P.node_buckets(x, k) for x in (codes >> np.uint64(2), codes & np.uint64(4**k - 1))]
    rows = sorted({(int(e[i]), int(c), min(runs[w], 255)) for e in ends for i, (c, w) in enumerate(zip(codes, runs, strict=True))})
    groups, held = [], []
    for row in rows:
        if len(held) >= n_nodes and held[-1][0] != row[0]:
            groups, held = [*groups, held], []
        held.append(row)
    got, stays = Counter(), {}
    for group in [*groups, held]:
        part = [np.array([r[i] for r in group], t) for i, t in ((0, np.int32), (1, np.int64), (2, np.int32))]
        for x in (r for b in P._contract([part], k + 1) for r in b.to_pylist()):
            whole = (x["src"] if x["arc_idx"] < 4 else rc(x["src"])) + x["seq"]
            assert (code(whole[:k]), code(whole[-k:]), len(x["seq"]), sum(x["mults"])) == (x["start"], x["end"], x["len"], x["cov"])
            stays[whole[:k]] = x["stays"]
            for i, m in enumerate(x["mults"]):
                got[whole[i : i + k + 1], m] += 1
    assert got == Counter({(w, min(n, 255)): 1 for c, n in runs.items() for w in {c, rc(c)}})
    out = Counter(s[:k] for s, _ in got)
    loops = {max(s[:k], rc(s[:k])) for s, _ in got if s[1:] in (s[:k], rc(s[:k]))}
    for node, stay in stays.items():
        assert stay == (out[node] != 1 or out[rc(node)] != 1 or max(node, rc(node)) in loops)


def test_first_arcs_are_those_that_reads_begin_with(spark):
    """The join with arcs0 shuffles the first arcs of reads, not all arcs."""
    rng = random.Random(4)
    texts = ["\n".join("".join(rng.choices("abcdefgh ", k=n)) for n in (3, 23, 24, 30_000, 5)) for _ in range(6)] * 2 + ["", None, "\n\n" + "b" * 40]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    for k in (23, 33):
        starts = A.bases(docs).where(f"length(seq) > {k}").selectExpr(f"left(seq, {k + 1}) AS seq").distinct()
        asked = {tuple(r) for r in A.count_arcs(starts, k).select("kmer", "arc_idx").collect()}
        before = shuffled_bytes(spark)
        got = sorted(map(tuple, A.first_arcs(docs, k).collect()))
        assert k > 31 or shuffled_bytes(spark) - before < 3 * 12 * 30_055
        assert got == sorted(r for r in map(tuple, A.count_arcs(docs, k).collect()) if r[:2] in asked)
