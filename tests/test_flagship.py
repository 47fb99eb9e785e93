"""The whole assembly against a slow one, written from the rules alone: dictionaries, one motif at a time by rank, no Spark."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomgraph.operators import clean
from loomgraph.operators.contigs import contigs
from loomgraph.plans.assembly import assemble


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def canon(s):
    return max(s, rc(s))


class Slow:
    """arcs: {(node, slot): [string, coverage, multiplicity]}."""

    def __init__(self, reads, k, cutoff):
        self.k, n = k, Counter()
        for r in reads:
            for i in range(len(r) - k):
                for e in (r[i : i + k + 1], rc(r[i : i + k + 1])):
                    node = canon(e[:k])
                    n[node, "ACGT".index(e[k]) + (0 if e[:k] == node else 4)] += 1
        self.arcs = {a: ["ACGT"[a[1] % 4], min(m, 255), min(m, 255)] for a, m in n.items() if min(m, 255) >= cutoff}

    def start(self, a):
        return a[0] if a[1] < 4 else rc(a[0])

    def end(self, a):
        return (self.start(a) + self.arcs[a][0])[-self.k :]

    def dst(self, a):
        return canon(self.end(a))

    def positive(self, a):
        return self.end(a) == self.dst(a)

    def twin(self, a):
        s = rc(self.start(a) + self.arcs[a][0])
        sides = range(4) if s[: self.k] == self.dst(a) else range(4, 8)
        # a k-mer is never its own complement, as k is odd
        return next(((self.dst(a), i) for i in sides if self.arcs.get((self.dst(a), i), [None])[0] == s[self.k :]), None)

    def nodes(self):
        out = defaultdict(list)
        for a in sorted(self.arcs):
            out[a[0]].append(a)
        return out

    def compact(self):
        nodes = self.nodes()
        stays = {x for x, own in nodes.items() if [a[1] < 4 for a in own] not in ([True, False],) or any(self.dst(a) == x for a in own)}
        out, seen = {}, set()

        def walk(first, until):
            a, s, cov = first, "", 0
            while True:
                seen.add(a)
                s, cov, x = s + self.arcs[a][0], cov + self.arcs[a][1], self.dst(a)
                if x in until:
                    break
                a = next(b for b in nodes[x] if self.start(b) == self.end(a))
            out[first] = [s, cov, cov // len(s)]

        for a in sorted(self.arcs):
            if a[0] in stays:
                walk(a, stays)
        for a in sorted(self.arcs, reverse=True):  # what is left are cycles, the largest k-mer of each first
            if a not in seen and a[0] not in stays:
                ring, b = set(), a
                while b[0] not in ring or b != a:
                    ring.add(b[0])
                    b = next(c for c in nodes[self.dst(b)] if self.start(c) == self.end(b))
                if a[0] == max(ring):
                    walk(a, {a[0]})
        self.arcs = out

    def drop(self, gone):
        for a in [*gone, *filter(None, map(self.twin, gone))]:
            self.arcs.pop(a, None)

    def tips(self):
        self.drop([own[0] for x, own in self.nodes().items() if len(own) == 1 and len(self.arcs[own[0]][0]) < self.k and self.dst(own[0]) != x])

    def weak(self):
        total = sum(len(s) for s, _, _ in self.arcs.values())
        mean = sum(len(s) * m for s, _, m in self.arcs.values()) // total if total else 0
        self.arcs = {a: v for a, v in self.arcs.items() if len(v[0]) >= 2 * self.k or v[2] * 4 >= mean}

    def first_only(self, motifs):
        """Of (weight, motif, nodes, ...) those that come first on all their nodes."""
        best = {}
        for m in motifs:
            for x in m[2]:
                best[x] = min(best.get(x, (-m[0], m[1])), (-m[0], m[1]))
        return [m for m in motifs if all(best[x] == (-m[0], m[1]) for x in m[2])]

    def edit(self, gone, grown):
        for a in gone:
            self.arcs.pop(a, None)
        self.arcs |= grown

    def triples(self):
        for own in self.nodes().values():
            if len(own) == 3:
                for i, j, o in ((own[0], own[1], own[2]), (own[0], own[2], own[1]), (own[1], own[2], own[0])):
                    if self.dst(i) == self.dst(j) != i[0] and self.dst(o) != self.dst(i):
                        yield i, j, o

    def bubbles(self):
        found = []
        for i, j, o in self.triples():
            if self.positive(i) == self.positive(j) and (i[1] < 4) == (j[1] < 4) != (o[1] < 4):
                x = j if self.arcs[i][2] > self.arcs[j][2] else i
                if self.twin(x):
                    found.append((max(self.arcs[i][2], self.arcs[j][2]), i[0], {i[0], self.dst(x)}, x))
        gone = [m[3] for m in self.first_only(found)]
        self.drop(gone)
        return len(gone)

    def loops(self):
        nodes, found, gone, grown = self.nodes(), [], [], {}
        for x, own in nodes.items():
            ring, outs = [a for a in own if self.dst(a) == x], [a for a in own if self.dst(a) != x]
            if not ring or not outs:
                continue
            side, o = (lambda a: a[1] < 4), outs[0]
            kind = None
            if len(ring) == 2 and self.positive(ring[0]) != self.positive(ring[1]) and (len(outs) == 1 or (len(outs) == 2 and side(outs[0]) != side(outs[1]))):
                p, q = [a for a in ring if side(a) == side(o)], [a for a in ring if side(a) != side(o)]
                if len(p) == len(q) == 1:
                    kind, p, q = "loop", p[0], q[0]
            elif len(ring) == 1:
                p = q = ring[0]
                if len(outs) == 2 and side(outs[0]) == side(outs[1]) != side(p):
                    kind = "loop"
                elif len(outs) == 1 and side(o) != side(p):
                    kind = "fold"
                elif len(outs) == 2 and side(outs[0]) != side(outs[1]) and len(self.arcs[p][0]) < 5 and any(self.arcs[a][2] > 2 * self.arcs[p][2] for a in outs):
                    gone.append(p)
            if kind and (t := self.twin(o)):
                found.append((self.arcs[p][2], x, {x, self.dst(o)}, kind, o, p, q, t))
        for _, _, _, kind, o, p, q, t in self.first_only(found):
            (so, co, _), (sp, cp, _), (sq, _, _), (st, _, _) = (self.arcs[a] for a in (o, p, q, t))
            gone += [o, q]
            if kind == "loop":
                grown[p] = [sp + so, co + cp, (co + cp) // len(sp + so)]
                grown[t] = [st + sq, co + cp, (co + cp) // len(sp + so)]
            else:
                grown[t] = [st + sp + so, 2 * co + cp, (2 * co + cp) // len(st + sp + so)]
        self.edit(gone, grown)

    def repeats(self):
        found = []
        for i, j, o in self.triples():
            if self.positive(i) != self.positive(j) and (i[1] < 4) != (j[1] < 4) and self.dst(o) != o[0]:
                p, q = (i, j) if (i[1] < 4) == (o[1] < 4) else (j, i)
                if all(t := [self.twin(a) for a in (p, q, o)]):
                    found.append((self.arcs[o][2], o[0], {o[0], self.dst(p), self.dst(o)}, p, q, o, *t))
        gone, grown = [], {}
        for _, _, _, p, q, o, tp, tq, to in self.first_only(found):
            s, b, m = self.arcs[p][0] + self.arcs[tq][0] + self.arcs[o][0], self.arcs[to][0] + self.arcs[q][0] + self.arcs[tp][0], self.arcs[o][2]
            gone += [p, tp]
            grown |= {o: [s, m * len(s), m], to: [b, m * len(b), m]}
        self.edit(gone, grown)

    def joined(self, *of):
        cov = sum(self.arcs[a][1] for a in of)
        return cov, cov // sum(len(self.arcs[a][0]) for a in of)

    def crosses(self):
        ends = {}
        for x, own in self.nodes().items():
            right, left = [a for a in own if a[1] < 4], [a for a in own if a[1] >= 4]
            if len(own) == 3 and right and left:
                b, outer = (right[0], left) if len(right) == 1 else (left[0], right)
                low, high = sorted(outer, key=lambda a: (self.arcs[a][2], a[1]))
                if all(self.twin(a) for a in (b, low, high)):
                    ends[x] = b, low, high
        found = []
        for x, (b, low, high) in ends.items():
            y = self.dst(b)
            if y in ends and ends[y][0] == self.twin(b) and x < y:
                yb, ylow, yhigh = ends[y]
                around = [self.dst(a) for a in (low, high, ylow, yhigh)]
                if x not in around and y not in around:
                    found.append((self.arcs[b][2], x, {x, y, *around}, b, yb, (low, ylow), (high, yhigh), y))
        gone, grown = [], {}
        for _, x, _, b, yb, *walks, y in self.first_only(found):
            gone += [a for a in self.arcs if a[0] in (x, y)]
            for a, ya in walks:
                value = self.joined(a, b, ya)
                grown[self.twin(a)] = [self.arcs[self.twin(a)][0] + self.arcs[b][0] + self.arcs[ya][0], *value]
                grown[self.twin(ya)] = [self.arcs[self.twin(ya)][0] + self.arcs[yb][0] + self.arcs[a][0], *value]
        self.edit(gone, grown)

    def crossings(self):
        found = []
        for x, own in self.nodes().items():
            right, left = ([a for a in own if (a[1] < 4) == s] for s in (True, False))
            if len(right) == len(left) == 2 and all(self.dst(a) != x and self.twin(a) for a in own):
                right, left = (sorted(s, key=lambda a: (self.arcs[a][2], a[1])) for s in (right, left))
                found.append((max(self.arcs[right[1]][2], self.arcs[left[1]][2]), x, {x, *map(self.dst, own)}, right, left))
        gone, grown = [], {}
        for _, x, _, right, left in self.first_only(found):
            gone += [*right, *left]
            for r, l in zip(right, left, strict=True):  # noqa: E741
                for a, b in ((r, l), (l, r)):
                    grown[self.twin(a)] = [self.arcs[self.twin(a)][0] + self.arcs[b][0], *self.joined(a, b)]
        self.edit(gone, grown)

    def stable(self, step):
        n = None
        while n != (n := len(self.arcs)):
            step()

    def clean(self, split=False):
        for _ in range(4):
            before = {a: tuple(v) for a, v in self.arcs.items()}
            self.tips()
            self.compact()
            self.weak()
            self.compact()
            self.stable(self.loops)
            while self.bubbles():
                pass
            self.stable(self.repeats)
            self.compact()
            if {a: tuple(v) for a, v in self.arcs.items()} == before:
                break
        self.stable(self.crosses)
        if split:
            self.stable(self.crossings)
            self.compact()

    def contigs(self, least=100):
        return Counter(canon(self.start(a) + s) for a, (s, _, _) in self.arcs.items() if len(s) >= least - self.k and (a[0] > self.dst(a) or (a[0] == self.dst(a) and self.start(a) + s <= rc(self.start(a) + s))))


def genome(seed):
    """Random DNA in which stretches return, also on the other strand, and reads of it with errors, from both strands."""
    r = random.Random(seed)
    dna = lambda n: "".join(r.choices("ACGT", k=n))
    parts = [dna(r.randint(20, 120)) for _ in range(5)]
    parts += [r.choice([parts[i % 5], rc(parts[i % 5])]) if r.random() < 0.5 else dna(r.randint(5, 90)) for i in range(8)]
    g = "".join(r.sample(parts, len(parts)))
    reads = []
    for _ in range(len(g) * 12 // 70):
        at = r.randrange(max(1, len(g) - 70))
        s = list(g[at : at + 70])
        for i in range(len(s)):
            if r.random() < 0.004:
                s[i] = r.choice("ACGT")
        reads.append(r.choice(["".join(s), rc("".join(s))]))
    return reads


def as_table(spark, reads):
    return spark.createDataFrame([(str(i), s) for i, s in enumerate(reads)], "read_id string, seq string")


@pytest.mark.parametrize("seed", range(3))
def test_assembly_is_that_of_the_slow_one(spark, seed):
    reads = []
    # genomes without a k-mer in common would be assembled one by one; a few at a time save rounds of jobs
    for part in range(10):
        reads += genome(10 * seed + part)
    model = Slow(reads, 21, 2)
    model.compact()
    model.clean(split=seed % 2 == 1)
    slow = model.contigs()
    got = Counter(canon(r["seq"]) for r in assemble(as_table(spark, reads), 21, 2, split=seed % 2 == 1).collect())
    assert sum(slow.values()) > 5 and got == slow


@pytest.mark.parametrize("step", ["bubbles", "loops", "repeats", "crosses", "crossings"])
def test_single_steps_edit_many_motifs(spark, step):
    """Each step on a graph where it has dozens of motifs, hairpins included, against the slow one."""
    from loomgraph.operators.compact import compact
    from loomgraph.plans.assembly import graph

    r = random.Random(step)
    dna = lambda n: "".join(r.choices("ACGT", k=n))
    reads = []
    for i in range(40):
        a, b, x, y = dna(60), dna(60), dna(30), dna(30)
        mid = "C" + dna({"loops": 19, "crossings": 19}.get(step, 34)) + "G"
        reads += {
            "bubbles": [a + x + b] * 5 + [a + y + b] * (2 + i % 4),
            "loops": [a + "A" + mid + mid + "T" + b] * 3 if i % 3 else [a + (h := dna(21)) + dna(4) + rc(h) + rc(b)] * 4,
            "repeats": [a + "A" + mid + mid + "T" + b] * 3,
            "crosses": [a + mid + b] * (4 + i % 4) + [x * 2 + mid + y * 2] * 3,
            "crossings": [a + mid + b] * (4 + i % 4) + [x * 2 + mid + y * 2] * (3 + i % 2),
        }[step]
    slow = Slow(reads, 21, 1)
    slow.compact()
    arcs = compact(graph(as_table(spark, reads), 21, 1), 21)
    own = {"bubbles": lambda a, k: clean.pop_bubbles(a, k)[0], "loops": clean.unroll_loops, "repeats": clean.linearise_repeats, "crosses": clean.resolve_cross_edges, "crossings": clean.split_crossings}[step]
    before = {a: tuple(v) for a, v in slow.arcs.items()}
    getattr(slow, step)()
    want = {a: tuple(v) for a, v in slow.arcs.items()}
    got = {(x["src"], x["arc_idx"]): (x["seq"], x["cov"], x["mult"]) for x in own(arcs, 21).collect()}
    assert got == want and len(set(before.items()) ^ set(want.items())) > 40
    assert contigs(arcs, 21).where(F.length("seq") < 100).count() == 0
