"""Error removal: tips, weak arcs, loops, parallel arcs, cross edges and crossing nodes.

Each step works on a snapshot of the arcs and edits an arc and its twin together. Where motifs share a node, the one with
the highest multiplicity (then the smallest node) goes first and the others wait for a later sweep; until_stable() makes
sweeps until there is nothing left to do. An arc that grows keeps its multiplicity unless said otherwise, and its coverage
becomes multiplicity times length.

Motifs are found on narrow rows: slots, lengths, multiplicities and ends. An arc that grows is described by the arcs it is
made of, and only the strings of these are fetched, when the motifs that come first are known.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.kmers import oriented
from loomgraph.operators.arcs import coverage, twins, with_ends
from loomgraph.operators.compact import joined
from loomgraph.plans.session import keep, scratch, stored, stored_count

COLUMNS = ("src", "arc_idx", "seq", "len", "cov", "mult", "dst", "dst_pos")
#: What motifs are found by, of each arc of a node.
NARROW = ("arc_idx", "len", "cov", "mult", "dst", "dst_pos")
_KEY = ["src", "arc_idx"]


def _without(arcs: DataFrame, gone: DataFrame) -> DataFrame:
    return arcs.join(gone.select(*_KEY).distinct(), _KEY, "left_anti")


def _spelled(arcs: DataFrame, grown: DataFrame) -> DataFrame:
    """grown (src, arc_idx, pieces, ...) with seq, the strings of its pieces (src, arc_idx) one after another."""
    rest = [c for c in grown.columns if c != "pieces"]
    asked = grown.select(*rest, F.posexplode("pieces").alias("at", "piece"))
    strings = arcs.select(F.struct("src", "arc_idx").alias("piece"), "seq")
    return asked.join(strings, "piece").groupBy(*rest).agg(joined("at", "seq"))


def _edited(arcs: DataFrame, gone: DataFrame, grown: DataFrame, k: int, nodes: DataFrame | None = None) -> DataFrame:
    """arcs without gone and all arcs of nodes, and with grown (src, arc_idx, pieces, len, cov, mult) in place of what stood there."""
    kept = arcs if nodes is None else arcs.join(nodes.select("src").distinct(), "src", "left_anti")
    kept = _without(kept, gone.select(*_KEY).union(grown.select(*_KEY)))
    return kept.select(*COLUMNS).unionByName(with_ends(_spelled(arcs, grown), k).select(*COLUMNS))


def _and_twins(arcs: DataFrame, gone: DataFrame, k: int) -> DataFrame:
    return gone.select(*_KEY).union(twins(arcs, k, gone).select("t_src", "t_idx"))


def _with_twins(arcs: DataFrame, motifs: DataFrame, names: tuple[str, ...], k: int) -> DataFrame:
    """motifs with, for each named arc x of src, the slot tx of its twin; motifs without one go."""
    asked = None
    for x in names:
        own = motifs.select("src", F.col(f"{x}.arc_idx").alias("arc_idx"))
        asked = own if asked is None else asked.union(own)
    there = stored(twins(arcs, k, asked), "twins")
    for x in names:
        side = there.select(F.col("src").alias("_s"), F.col("arc_idx").alias("_i"), F.col("t_idx").alias(f"t{x}"))
        motifs = motifs.join(side, (F.col("src") == F.col("_s")) & (F.col(f"{x}.arc_idx") == F.col("_i"))).drop("_s", "_i")
    return motifs


def _grown(motifs: DataFrame, src: str, slot: str, pieces: list[tuple[str, str]], *values: Column) -> DataFrame:
    """The arc in a slot of src, made of the arcs in the slots of the nodes that pieces name, with len, cov and mult."""
    made = F.array(*(F.struct(F.col(n).alias("src"), F.col(s).alias("arc_idx")) for n, s in pieces))
    return motifs.select(F.col(src).alias("src"), F.col(slot).alias("arc_idx"), made.alias("pieces"), *(v.alias(n) for v, n in zip(values, ("len", "cov", "mult"), strict=True)))


def _slots(motifs: DataFrame, *at: tuple[str, str]) -> DataFrame:
    """The arcs in the slots of the nodes that are named."""
    out = None
    for n, s in at:
        own = motifs.select(F.col(n).alias("src"), F.col(s).alias("arc_idx"))
        out = own if out is None else out.union(own)
    return out


def first_only(motifs: DataFrame) -> DataFrame:
    """Motifs (motif, weight, nodes) that come first on all their nodes."""
    rank = F.struct((-F.col("weight")).alias("w"), F.col("motif").alias("m"))
    each = motifs.select("motif", rank.alias("rank"), F.explode(F.array_distinct("nodes")).alias("node"))
    best = each.groupBy("node").agg(F.min("rank").alias("best"))
    losers = each.join(best, "node").where(F.col("rank") != F.col("best")).select("motif").distinct()
    return motifs.join(losers, "motif", "left_anti")


def until_stable(step: Callable[[DataFrame, int], DataFrame], arcs: DataFrame, k: int) -> DataFrame:
    """A stored table of arcs after so many sweeps of a step that edits at least two arcs into one, or removes some."""
    n = arcs.count()
    while True:
        with scratch():
            after, m = stored_count(step(arcs, k), "sweep")
            keep(after)
        if m == n:
            return after
        arcs, n = after, m


def remove_tips(arcs: DataFrame, k: int) -> DataFrame:
    """A node whose only arc is shorter than k goes, with the arc and its twin; its own neighbour stays."""
    only = arcs.groupBy("src").agg(F.count("*").alias("n"), F.first("arc_idx").alias("arc_idx"), F.first("len").alias("len"), F.first("dst").alias("dst"))
    tips = only.where((F.col("n") == 1) & (F.col("len") < k) & (F.col("dst") != F.col("src")))
    return _without(arcs, _and_twins(arcs, tips, k))


def remove_low_coverage(arcs: DataFrame, k: int) -> DataFrame:
    """Arcs shorter than 2k with less than a quarter of the average coverage go."""
    weighed = arcs.crossJoin(F.broadcast(coverage(arcs)))  # one row
    return weighed.where(~((F.col("len") < 2 * k) & (F.col("mult") * 4 < F.col("avg_coverage")))).drop("avg_coverage")


def _shape(arcs: DataFrame) -> DataFrame:
    """Each node's arcs in slot order, without their strings; a node has eight at most."""
    return arcs.groupBy("src").agg(F.array_sort(F.collect_list(F.struct(*NARROW))).alias("a"))


def _side(x: Column) -> Column:
    return F.when(x["arc_idx"] < 4, 0).otherwise(1)


def _at(array: str | Column, i: int) -> Column:
    return F.get(array, F.lit(i))


def parallel_pairs(arcs: DataFrame) -> DataFrame:
    """src, i, j, dst of slots i < j of a node with one neighbour."""
    a, b = arcs.alias("a"), arcs.alias("b")
    same = (F.col("a.src") == F.col("b.src")) & (F.col("a.dst") == F.col("b.dst")) & (F.col("a.arc_idx") < F.col("b.arc_idx"))
    return a.join(b, same).select("a.src", F.col("a.arc_idx").alias("i"), F.col("b.arc_idx").alias("j"), "a.dst")


def _triples(arcs: DataFrame) -> DataFrame:
    """Nodes of degree three with two arcs i < j to one other node and a third, o, elsewhere."""
    three = _shape(arcs).where(F.size("a") == 3)
    pick = F.explode(F.array(*(F.struct(_at("a", p).alias("i"), _at("a", q).alias("j"), _at("a", r).alias("o")) for p, q, r in ((0, 1, 2), (0, 2, 1), (1, 2, 0)))))
    t = three.select("src", pick.alias("m")).select("src", "m.*")
    return t.where((F.col("i.dst") == F.col("j.dst")) & (F.col("i.dst") != F.col("src")) & (F.col("o.dst") != F.col("i.dst")))


def bubbles(arcs: DataFrame, k: int) -> DataFrame:
    """src, arc_idx, seq of the weaker of two like arcs, the lower slot on a tie, where their twins exist."""
    t = _triples(arcs).where((F.col("i.dst_pos") == F.col("j.dst_pos")) & (_side(F.col("i")) == _side(F.col("j"))) & (_side(F.col("i")) != _side(F.col("o"))))
    drop = F.when(F.col("i.mult") > F.col("j.mult"), F.col("j")).otherwise(F.col("i"))
    found = t.select("src", drop.alias("x"), F.greatest("i.mult", "j.mult").alias("weight")).withColumn("arc_idx", F.col("x.arc_idx"))
    found = found.join(twins(arcs, k, found).select(*_KEY), _KEY)
    first = first_only(found.select(F.col("src").alias("motif"), "weight", F.array(F.col("src"), F.col("x.dst")).alias("nodes"), "arc_idx"))
    named = first.select(F.col("motif").alias("src"), "arc_idx").join(arcs.select(*_KEY, "seq"), _KEY)
    return named.select(*_KEY, F.concat(oriented(F.col("src"), F.col("arc_idx")), F.col("seq")).alias("seq"))


def pop_bubbles(arcs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The arcs left, and the removed sequences."""
    found = stored(bubbles(arcs, k), "bubbles")
    return _without(arcs, _and_twins(arcs, found, k)), found.select("seq")


def linearise_repeats(arcs: DataFrame, k: int) -> DataFrame:
    """X - Y - X walks: where i and j leave X on both sides for one Y, the walk that enters by o passes Y once on its way.

    The arc on o's side of X (p) and its twin go; the arc o becomes p, the twin of the other (q), o; its twin becomes itself,
    q, the twin of p.
    """
    t = _triples(arcs).where((F.col("i.dst_pos") != F.col("j.dst_pos")) & (_side(F.col("i")) != _side(F.col("j"))) & (F.col("o.dst") != F.col("src")))
    same = _side(F.col("i")) == _side(F.col("o"))
    t = t.select("src", F.when(same, F.col("i")).otherwise(F.col("j")).alias("p"), F.when(same, F.col("j")).otherwise(F.col("i")).alias("q"), "o")
    t = _with_twins(arcs, t, ("p", "q", "o"), k)
    motifs = t.select(F.col("src").alias("motif"), F.col("o.mult").alias("weight"), F.array(F.col("src"), F.col("p.dst"), F.col("o.dst")).alias("nodes"), "*")
    m = stored(first_only(motifs), "repeats")
    length = F.col("o.len") + F.col("p.len") + F.col("q.len")
    values = (length, F.col("o.mult") * length, F.col("o.mult"))
    grown = _grown(m, "src", "o.arc_idx", [("src", "p.arc_idx"), ("q.dst", "tq"), ("src", "o.arc_idx")], *values).union(
        _grown(m, "o.dst", "to", [("o.dst", "to"), ("src", "q.arc_idx"), ("p.dst", "tp")], *values)
    )
    return _edited(arcs, _slots(m, ("src", "p.arc_idx"), ("p.dst", "tp")), grown, k)


def unroll_loops(arcs: DataFrame, k: int) -> DataFrame:
    """Repeats that a walk passes twice, and hairpins.

    A node with a loop and its twin, and one or two further arcs (not both on one side): the first further arc, o, is reached
    through the loop once; the loop's two slots become that walk. So it is with a hairpin that has both of two further arcs
    opposite to it: the walk between those turns round in it. A hairpin that is weaker than half of a further arc and
    shorter than 5 goes, if the two further arcs are on opposite sides; one at the end of a path is folded into it.
    Coverages add up.
    """
    shape = _shape(arcs).withColumns({"loops": F.filter("a", lambda x: x["dst"] == F.col("src")), "outs": F.filter("a", lambda x: x["dst"] != F.col("src"))}).where((F.size("loops") > 0) & (F.size("outs") > 0))
    two = shape.where((F.size("loops") == 2) & (_at("loops", 0)["dst_pos"] != _at("loops", 1)["dst_pos"]) & F.size("a").isin(3, 4))
    two = two.where((F.size("outs") == 1) | (_side(_at("outs", 0)) != _side(_at("outs", 1))))
    o = _at("outs", 0)
    ahead = F.filter("loops", lambda x: _side(x) == _side(o))
    back = F.filter("loops", lambda x: _side(x) != _side(o))
    two = two.where((F.size(ahead) == 1) & (F.size(back) == 1)).select("src", o.alias("o"), _at(ahead, 0).alias("p"), _at(back, 0).alias("q"))
    one = shape.where(F.size("loops") == 1)
    hairpin = _at("loops", 0)
    turn = one.where((F.size("outs") == 2) & (_side(o) == _side(_at("outs", 1))) & (_side(o) != _side(hairpin))).select("src", o.alias("o"), hairpin.alias("p"), hairpin.alias("q"))
    fold = one.where((F.size("outs") == 1) & (_side(o) != _side(hairpin))).select("src", o.alias("o"), hairpin.alias("p"), hairpin.alias("q"))
    both = two.unionByName(turn).withColumn("kind", F.lit("loop")).unionByName(fold.withColumn("kind", F.lit("fold")))
    t = _with_twins(arcs, both, ("o",), k)
    m = stored(first_only(t.select(F.col("src").alias("motif"), F.col("p.mult").alias("weight"), F.array("src", "o.dst").alias("nodes"), "*")), "loops")
    length = F.col("o.len") + F.col("p.len")
    total = F.col("o.cov") + F.col("p.cov")
    loops, folds = m.where(F.col("kind") == "loop"), m.where(F.col("kind") == "fold")
    values = (length, total, F.expr("(o.cov + p.cov) div (o.len + p.len)"))
    grown = _grown(loops, "src", "p.arc_idx", [("src", "p.arc_idx"), ("src", "o.arc_idx")], *values).union(_grown(loops, "o.dst", "to", [("o.dst", "to"), ("src", "q.arc_idx")], *values))
    values = (length + F.col("o.len"), total + F.col("o.cov"), F.expr("(2 * o.cov + p.cov) div (2 * o.len + p.len)"))
    grown = grown.union(_grown(folds, "o.dst", "to", [("o.dst", "to"), ("src", "p.arc_idx"), ("src", "o.arc_idx")], *values))
    gone = _slots(m, ("src", "o.arc_idx"), ("src", "q.arc_idx"))
    weak = one.where((F.size("outs") == 2) & (_side(o) != _side(_at("outs", 1))) & (hairpin["len"] < 5) & F.exists("outs", lambda x: x["mult"] > 2 * hairpin["mult"]))
    return _edited(arcs, gone.union(weak.select("src", hairpin["arc_idx"])), grown, k)


def _pairs(side: Column) -> Column:
    """The arcs of a side from the weakest on, the lower slot first on a tie."""
    return F.array_sort(F.transform(side, lambda x: F.struct(x["mult"].alias("m"), x["arc_idx"].alias("i"), x.alias("x"))))


def resolve_cross_edges(arcs: DataFrame, k: int) -> DataFrame:
    """A bridge X - Y with two arcs beyond each end: the weaker outer arcs are one walk, the stronger ones another.

    Each walk gets the bridge; X and Y go. A walk's multiplicity is the length-weighted mean of its parts.
    """
    three = _shape(arcs).where(F.size("a") == 3)
    right, left = F.filter("a", lambda x: x["arc_idx"] < 4), F.filter("a", lambda x: x["arc_idx"] >= 4)
    ends = three.where((F.size(right) > 0) & (F.size(left) > 0)).select("src", F.when(F.size(right) == 1, _at(right, 0)).otherwise(_at(left, 0)).alias("b"), F.when(F.size(right) == 1, left).otherwise(right).alias("outer"))
    ranked = _pairs(F.col("outer"))
    ends = ends.select("src", "b", _at(ranked, 0)["x"].alias("low"), _at(ranked, 1)["x"].alias("high"))
    ends = stored(_with_twins(arcs, ends, ("b", "low", "high"), k), "ends")
    y = ends.select(F.col("src").alias("y"), F.col("b").alias("yb"), *(F.col(c).alias(f"y{c}") for c in ("low", "high", "tlow", "thigh")))
    m = ends.join(y, (F.col("b.dst") == F.col("y")) & (F.col("tb") == F.col("yb.arc_idx")) & (F.col("src") < F.col("y")))
    for a in ("low.dst", "high.dst", "ylow.dst", "yhigh.dst"):
        m = m.where((F.col(a) != F.col("src")) & (F.col(a) != F.col("y")))
    motifs = m.select(F.col("src").alias("motif"), F.col("b.mult").alias("weight"), F.array("src", "y", "low.dst", "high.dst", "ylow.dst", "yhigh.dst").alias("nodes"), "*")
    m = stored(first_only(motifs), "cross")
    grown = None
    for c in ("low", "high"):
        length = F.col(f"{c}.len") + F.col("b.len") + F.col(f"y{c}.len")
        total = F.col(f"{c}.cov") + F.col("b.cov") + F.col(f"y{c}.cov")
        values = (length, total, F.floor(total / length))
        there = _grown(m, f"{c}.dst", f"t{c}", [(f"{c}.dst", f"t{c}"), ("src", "b.arc_idx"), ("y", f"y{c}.arc_idx")], *values)
        back = _grown(m, f"y{c}.dst", f"yt{c}", [(f"y{c}.dst", f"yt{c}"), ("y", "yb.arc_idx"), ("src", f"{c}.arc_idx")], *values)
        grown = there.union(back) if grown is None else grown.union(there).union(back)
    return _edited(arcs, grown, grown, k, m.select("src").union(m.select("y")))


def split_crossings(arcs: DataFrame, k: int) -> DataFrame:
    """A node with two arcs on either side, none to itself: the weaker two are one walk through it, the stronger two another.

    Each walk's arcs are joined at the node, which goes. A walk's multiplicity is the length-weighted mean of its parts. This
    is a guess where multiplicities are close, so that an assembly makes it only if asked to.
    """
    four = _shape(arcs).where((F.size("a") == 4) & ~F.exists("a", lambda x: x["dst"] == F.col("src")))
    right, left = F.filter("a", lambda x: x["arc_idx"] < 4), F.filter("a", lambda x: x["arc_idx"] >= 4)
    named = [_at(_pairs(side), i)["x"].alias(f"{c}{i}") for c, side in (("r", right), ("l", left)) for i in (0, 1)]
    ends = four.where(F.size(right) == 2).select("src", *named)
    t = _with_twins(arcs, ends, ("r0", "r1", "l0", "l1"), k)
    nodes = F.array("src", "r0.dst", "r1.dst", "l0.dst", "l1.dst")
    m = stored(first_only(t.select(F.col("src").alias("motif"), F.greatest("r1.mult", "l1.mult").alias("weight"), nodes.alias("nodes"), "*")), "crossings")
    grown = None
    for i in (0, 1):
        r, l = f"r{i}", f"l{i}"  # noqa: E741
        values = (F.col(f"{r}.len") + F.col(f"{l}.len"), F.col(f"{r}.cov") + F.col(f"{l}.cov"), F.expr(f"({r}.cov + {l}.cov) div ({r}.len + {l}.len)"))
        for a, b in ((r, l), (l, r)):  # from the neighbour of a, through the node, along b
            own = _grown(m, f"{a}.dst", f"t{a}", [(f"{a}.dst", f"t{a}"), ("src", f"{b}.arc_idx")], *values)
            grown = own if grown is None else grown.union(own)
    return _edited(arcs, grown, grown, k, m)
