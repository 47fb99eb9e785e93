"""SQL for the queries, in DuckDB's dialect. Each builds on common table expressions over documents at k=23, cutoff 5.

Steps that edit motifs are shown at k=19, where all of them occur; the removal of weak arcs on reads from part names,
most of which are covered often enough for that.
"""

from __future__ import annotations

from types import SimpleNamespace

from loomgraph.functions.kmers import AS_BASES, LETTERS

K, CUTOFF = 23, 5
MOTIF_K = 19
PARTS_CUTOFF = 1
_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def rc(x: str) -> str:
    return _RC.format(x)


def ctes(K: int, CUTOFF: int, table: str = "documents", id: str = "doc_id", text: str = "text") -> SimpleNamespace:  # noqa: N803, A002
    """Common table expressions, from reads to contigs, over the lines of a table."""
    READS = f"""
    lines AS (SELECT {id} AS doc_id, unnest(string_split({text}, chr(10))) AS t, generate_subscripts(string_split({text}, chr(10)), 1) - 1 AS line FROM {table}),
    reads AS (SELECT * FROM (SELECT doc_id || '/' || line AS read_id,
      regexp_replace(translate(t, '{LETTERS}{LETTERS.upper()}', '{AS_BASES * 2}'), '[^ACGT]', 'A', 'g') AS seq FROM lines) WHERE length(seq) >= {K})"""

    KMERS = f"""{READS},
    occ AS (SELECT read_id, i, substr(seq, i, {K}) AS w FROM (SELECT read_id, seq, unnest(range(1, length(seq) - {K} + 2)) AS i FROM reads)),
    kmers AS (SELECT greatest(w, {rc("w")}) AS kmer, count(*) AS n FROM occ GROUP BY 1)"""

    # from neighbouring windows, seen from both: the engine counts runs of k+1 bases instead
    ARCS0 = f"""{READS},
    pairs AS (SELECT substr(seq, i, {K}) AS pre, substr(seq, i + 1, {K}) AS cur FROM (SELECT seq, unnest(range(1, length(seq) - {K} + 1)) AS i FROM reads WHERE length(seq) > {K})),
    ends AS (
      SELECT greatest(pre, {rc("pre")}) AS kmer, instr('ACGT', right(cur, 1)) - 1 + CASE WHEN pre >= {rc("pre")} THEN 0 ELSE 4 END AS arc_idx FROM pairs
      UNION ALL
      SELECT greatest(cur, {rc("cur")}), instr('TGCA', left(pre, 1)) - 1 + CASE WHEN cur >= {rc("cur")} THEN 4 ELSE 0 END FROM pairs),
    arcs0 AS (SELECT kmer, CAST(arc_idx AS INTEGER) AS arc_idx, CAST(least(count(*), 255) AS BIGINT) AS mult FROM ends GROUP BY ALL)"""

    ARCS = f"""{ARCS0},
    cut AS (SELECT kmer AS src, arc_idx, mult, substr('ACGT', arc_idx % 4 + 1, 1) AS seq, CASE WHEN arc_idx < 4 THEN kmer ELSE {rc("kmer")} END AS os FROM arcs0 WHERE mult >= {CUTOFF}),
    arcs AS (SELECT *, greatest(od, {rc("od")}) AS dst, od >= {rc("od")} AS dst_pos FROM (SELECT *, right(os || seq, {K}) AS od FROM cut)),
    deg AS (SELECT src, count(*) FILTER (arc_idx < 4) AS right_degree, count(*) FILTER (arc_idx >= 4) AS left_degree FROM arcs GROUP BY src)"""

    # walks from nodes that stay; then each cycle from its largest k-mer
    COMPACT = f"""{ARCS},
    stays AS (SELECT src FROM arcs GROUP BY src HAVING count(*) FILTER (arc_idx < 4) <> 1 OR count(*) FILTER (arc_idx >= 4) <> 1 OR count(*) FILTER (dst = src) > 0),
    walk(head, hidx, od, seq, n, cov) AS (
      SELECT src, arc_idx, od, seq, 1, mult FROM arcs WHERE src IN (SELECT src FROM stays)
      UNION ALL
      SELECT w.head, w.hidx, a.od, w.seq || a.seq, w.n + 1, w.cov + a.mult FROM walk w JOIN arcs a ON a.os = w.od
      WHERE greatest(w.od, {rc("w.od")}) NOT IN (SELECT src FROM stays)),
    passed(id) AS (SELECT DISTINCT os FROM (
      WITH RECURSIVE r(od) AS (SELECT od FROM arcs WHERE src IN (SELECT src FROM stays)
        UNION SELECT a.od FROM r JOIN arcs a ON a.os = r.od WHERE greatest(r.od, {rc("r.od")}) NOT IN (SELECT src FROM stays))
      SELECT od AS os FROM r)),
    rest AS (SELECT * FROM arcs WHERE src NOT IN (SELECT src FROM stays) AND os NOT IN (SELECT id FROM passed)),
    ring(start, od, seq, n, cov, top) AS (
      SELECT os, od, seq, 1, mult, src FROM rest
      UNION ALL
      SELECT r.start, a.od, r.seq || a.seq, r.n + 1, r.cov + a.mult, greatest(r.top, a.src) FROM ring r JOIN rest a ON a.os = r.od WHERE greatest(r.od, {rc("r.od")}) <> greatest(r.start, {rc("r.start")})),
    rings AS (SELECT a.src AS head, a.arc_idx AS hidx, r.od, r.seq, r.n, r.cov FROM ring r JOIN rest a ON a.os = r.start
      WHERE greatest(r.od, {rc("r.od")}) = a.src AND a.src = r.top AND a.src = (SELECT max(b.src) FROM rest b WHERE b.os IN (SELECT od FROM ring x WHERE x.start = r.start))),
    ended AS (SELECT * FROM walk WHERE greatest(od, {rc("od")}) IN (SELECT src FROM stays) UNION ALL SELECT * FROM rings),
    compacted AS (SELECT head AS src, hidx AS arc_idx, seq, CAST(n AS BIGINT) AS len, CAST(cov AS BIGINT) AS cov, CAST(cov // n AS BIGINT) AS mult, greatest(od, {rc("od")}) AS dst, od >= {rc("od")} AS dst_pos FROM ended)"""

    CONTIGS = f"""{COMPACT},
    spelled AS (SELECT *, CASE WHEN arc_idx < 4 THEN src ELSE {rc("src")} END || seq AS s FROM compacted WHERE len >= {100 - K}),
    contigs AS (SELECT 'contig_NodeID' || src || '_Index' || arc_idx || '_Len' || length(s) || '_Mul' || mult AS name, src, arc_idx, s AS seq, length(s) AS len, mult
      FROM spelled WHERE src > dst OR (src = dst AND s <= {rc("s")}))"""

    PAIRS = """pairs3 AS (SELECT a.src, a.arc_idx AS i, b.arc_idx AS j, a.dst FROM compacted a JOIN compacted b ON a.src = b.src AND a.dst = b.dst AND a.arc_idx < b.arc_idx)"""

    TWIN = f"""twin AS (SELECT a.src, a.arc_idx, a.dst AS t_src, min(b.arc_idx) AS t_idx FROM arcs a JOIN arcs b
      ON b.src = a.dst AND b.os = {rc("a.od")} AND b.seq = right({rc("a.os || a.seq")}, 1) GROUP BY ALL)"""

    COMPACT_TWIN = f"""t AS (
      SELECT a.*, CASE WHEN a.arc_idx < 4 THEN 0 ELSE 1 END AS side, b.arc_idx AS t_idx, b.seq AS t_seq
      FROM (SELECT *, CASE WHEN arc_idx < 4 THEN src ELSE {rc("src")} END AS os FROM compacted) a LEFT JOIN compacted b
      ON b.src = a.dst AND (b.arc_idx >= 4) = a.dst_pos AND b.seq = substr({rc("a.os || a.seq")}, {K} + 1)
      QUALIFY row_number() OVER (PARTITION BY a.src, a.arc_idx ORDER BY b.arc_idx) = 1),
    node AS (SELECT src, count(*) AS d FROM compacted GROUP BY src),
    tri AS (SELECT i, j, o FROM t i JOIN t j ON i.src = j.src AND i.arc_idx < j.arc_idx AND i.dst = j.dst
      JOIN t o ON o.src = i.src AND o.arc_idx <> i.arc_idx AND o.arc_idx <> j.arc_idx JOIN node n ON n.src = i.src
      WHERE n.d = 3 AND i.dst <> i.src AND o.dst <> i.dst)"""
    # of motifs (motif, weight, nodes), those that come first on all their nodes
    FIRST = """each AS (SELECT motif, row_number() OVER (PARTITION BY node ORDER BY weight DESC, motif) AS place
      FROM (SELECT DISTINCT motif, weight, unnest(nodes) AS node FROM m)),
    win AS (SELECT m.* FROM m JOIN (SELECT motif FROM each GROUP BY motif HAVING max(place) = 1) USING (motif))"""
    # compacted arcs without those gone, and with those grown in the place of what stood there
    EDITED = f"""SELECT c.* FROM compacted c ANTI JOIN (SELECT src, arc_idx FROM gone UNION SELECT src, arc_idx FROM grown) e ON c.src = e.src AND c.arc_idx = e.arc_idx
    UNION ALL SELECT src, arc_idx, seq, CAST(len AS BIGINT), CAST(cov AS BIGINT), CAST(mult AS BIGINT), greatest(od, {rc("od")}), od >= {rc("od")}
    FROM (SELECT *, right(CASE WHEN arc_idx < 4 THEN src ELSE {rc("src")} END || seq, {K}) AS od FROM grown)"""
    return SimpleNamespace(**{k: v for k, v in locals().items() if k.isupper()})


AT = ctes(K, CUTOFF)
MOTIF = ctes(MOTIF_K, CUTOFF)
PARTS = ctes(K, PARTS_CUTOFF, "part", "p_partkey", "p_name || ' ' || p_type || ' ' || p_brand")

BUBBLES = f"""{MOTIF.COMPACT}, {MOTIF.COMPACT_TWIN},
m AS (SELECT x.src AS motif, w AS weight, [x.src, x.dst] AS nodes, x FROM (
  SELECT CASE WHEN i.mult > j.mult THEN j ELSE i END AS x, greatest(i.mult, j.mult) AS w FROM tri WHERE i.dst_pos = j.dst_pos AND i.side = j.side AND i.side <> o.side)
  WHERE x.t_idx IS NOT NULL), {MOTIF.FIRST}"""

LOOPS = f"""{MOTIF.COMPACT}, {MOTIF.COMPACT_TWIN},
shape AS (SELECT src, list(t ORDER BY arc_idx) FILTER (dst = src) AS l, list(t ORDER BY arc_idx) FILTER (dst <> src) AS u FROM t GROUP BY src),
kinds AS (
  SELECT src, 'loop' AS kind, u[1] AS o, list_filter(l, lambda x: x.side = u[1].side)[1] AS p, list_filter(l, lambda x: x.side <> u[1].side)[1] AS q FROM shape
  WHERE len(l) = 2 AND l[1].dst_pos <> l[2].dst_pos AND l[1].side <> l[2].side AND (len(u) = 1 OR (len(u) = 2 AND u[1].side <> u[2].side))
  UNION ALL
  SELECT src, 'loop', u[1], l[1], l[1] FROM shape WHERE len(l) = 1 AND len(u) = 2 AND u[1].side = u[2].side AND u[1].side <> l[1].side
  UNION ALL
  SELECT src, 'fold', u[1], l[1], l[1] FROM shape WHERE len(l) = 1 AND len(u) = 1 AND u[1].side <> l[1].side),
m AS (SELECT src AS motif, p.mult AS weight, [src, o.dst] AS nodes, * FROM kinds WHERE o.t_idx IS NOT NULL), {MOTIF.FIRST},
grown AS (
  SELECT src, p.arc_idx AS arc_idx, p.seq || o.seq AS seq, o.len + p.len AS len, o.cov + p.cov AS cov, (o.cov + p.cov) // (o.len + p.len) AS mult FROM win WHERE kind = 'loop'
  UNION ALL
  SELECT o.dst, o.t_idx, o.t_seq || q.seq, o.len + p.len, o.cov + p.cov, (o.cov + p.cov) // (o.len + p.len) FROM win WHERE kind = 'loop'
  UNION ALL
  SELECT o.dst, o.t_idx, o.t_seq || p.seq || o.seq, 2 * o.len + p.len, 2 * o.cov + p.cov, (2 * o.cov + p.cov) // (2 * o.len + p.len) FROM win WHERE kind = 'fold'),
gone AS (
  SELECT src, o.arc_idx AS arc_idx FROM win UNION ALL SELECT src, q.arc_idx FROM win UNION ALL
  SELECT src, l[1].arc_idx FROM shape WHERE len(l) = 1 AND len(u) = 2 AND u[1].side <> u[2].side AND l[1].len < 5 AND greatest(u[1].mult, u[2].mult) > 2 * l[1].mult)"""

REPEATS = f"""{MOTIF.COMPACT}, {MOTIF.COMPACT_TWIN},
pq AS (SELECT CASE WHEN i.side = o.side THEN i ELSE j END AS p, CASE WHEN i.side = o.side THEN j ELSE i END AS q, o FROM tri
  WHERE i.dst_pos <> j.dst_pos AND i.side <> j.side AND o.dst <> o.src),
m AS (SELECT o.src AS motif, o.mult AS weight, [o.src, p.dst, o.dst] AS nodes, *, o.len + p.len + q.len AS total FROM pq WHERE p.t_idx IS NOT NULL AND q.t_idx IS NOT NULL AND o.t_idx IS NOT NULL), {MOTIF.FIRST},
grown AS (
  SELECT o.src AS src, o.arc_idx AS arc_idx, p.seq || q.t_seq || o.seq AS seq, total AS len, o.mult * total AS cov, o.mult AS mult FROM win
  UNION ALL
  SELECT o.dst, o.t_idx, o.t_seq || q.seq || p.t_seq, total, o.mult * total, o.mult FROM win),
gone AS (SELECT p.src AS src, p.arc_idx AS arc_idx FROM win UNION ALL SELECT p.dst, p.t_idx FROM win)"""


def _walks(*names: str) -> str:
    """The two arcs of each walk over a bridge, through the weaker or the stronger outer arcs."""
    value = "{c}.len + b.len + y.{c}.len AS len, {c}.cov + b.cov + y.{c}.cov AS cov, ({c}.cov + b.cov + y.{c}.cov) // ({c}.len + b.len + y.{c}.len) AS mult"
    there = "SELECT {c}.dst AS src, {c}.t_idx AS arc_idx, {c}.t_seq || b.seq || y.{c}.seq AS seq, " + value + " FROM win"
    back = "SELECT y.{c}.dst, y.{c}.t_idx, y.{c}.t_seq || y.b.seq || {c}.seq, " + value + " FROM win"
    return " UNION ALL ".join(x.format(c=c) for c in names for x in (there, back))


CROSSES = f"""{MOTIF.COMPACT}, {MOTIF.COMPACT_TWIN},
sides AS (SELECT src, list(t ORDER BY mult, arc_idx) FILTER (side = 0) AS r, list(t ORDER BY mult, arc_idx) FILTER (side = 1) AS l FROM t GROUP BY src HAVING count(*) = 3),
outer_pairs AS (SELECT src, b, x[1] AS low, x[2] AS high FROM (SELECT src, CASE WHEN len(r) = 1 THEN r[1] ELSE l[1] END AS b, CASE WHEN len(r) = 1 THEN l ELSE r END AS x FROM sides WHERE len(r) > 0 AND len(l) > 0)
  WHERE b.t_idx IS NOT NULL AND x[1].t_idx IS NOT NULL AND x[2].t_idx IS NOT NULL),
m AS (SELECT x.src AS motif, x.b.mult AS weight, [x.src, y.src, x.low.dst, x.high.dst, y.low.dst, y.high.dst] AS nodes, x.src AS x_src, x.b AS b, x.low AS low, x.high AS high, y
  FROM outer_pairs x JOIN outer_pairs y ON y.src = x.b.dst AND y.b.arc_idx = x.b.t_idx AND x.src < y.src
  WHERE x.src NOT IN (x.low.dst, x.high.dst, y.low.dst, y.high.dst) AND y.src NOT IN (x.low.dst, x.high.dst, y.low.dst, y.high.dst)), {MOTIF.FIRST},
grown AS ({_walks("low", "high")}),
gone AS (SELECT c.src, c.arc_idx FROM compacted c WHERE c.src IN (SELECT x_src FROM win UNION SELECT y.src FROM win))"""

CROSSINGS = f"""{MOTIF.COMPACT}, {MOTIF.COMPACT_TWIN},
sides AS (SELECT src, list(t ORDER BY mult, arc_idx) FILTER (side = 0) AS r, list(t ORDER BY mult, arc_idx) FILTER (side = 1) AS l FROM t
  GROUP BY src HAVING count(*) = 4 AND count(*) FILTER (dst = src) = 0 AND count(*) FILTER (side = 0) = 2 AND count(t_idx) = 4),
m AS (SELECT src AS motif, greatest(r[2].mult, l[2].mult) AS weight, [src, r[1].dst, r[2].dst, l[1].dst, l[2].dst] AS nodes, r, l FROM sides), {MOTIF.FIRST},
walks AS (SELECT unnest([r[1], r[2], l[1], l[2]]) AS a, unnest([l[1], l[2], r[1], r[2]]) AS b FROM win),
grown AS (SELECT a.dst AS src, a.t_idx AS arc_idx, a.t_seq || b.seq AS seq, a.len + b.len AS len, a.cov + b.cov AS cov, (a.cov + b.cov) // (a.len + b.len) AS mult FROM walks),
gone AS (SELECT c.src, c.arc_idx FROM compacted c WHERE c.src IN (SELECT motif FROM win))"""

_PACKED = " + ".join(f"(instr('ACGT', substr(small, {K - j}, 1)) - 1) * {4 ** (j % 4) * 19 ** ((K + 3) // 4 - 1 - j // 4)}" for j in range(K))


def q(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes} {select}"


ORACLE_SQL = {
    "reads_sanitized": q(AT.READS, "SELECT * FROM reads"),
    "kmer_canonical_counts": q(AT.KMERS, "SELECT kmer, n FROM kmers"),
    "kmer_distinct": q(AT.KMERS, "SELECT count(*) AS n_kmers, CAST(sum(n) AS BIGINT) AS n_occurrences FROM kmers"),
    "arc_multiplicity": q(AT.ARCS0, "SELECT * FROM arcs0"),
    "arc_histogram": q(
        f"{AT.ARCS0}, bins AS (SELECT least(mult, 250) AS b, count(*) AS n FROM arcs0 GROUP BY 1), "
        f"nk AS (SELECT count(*) AS n FROM (SELECT DISTINCT greatest(w, {rc('w')}) FROM (SELECT substr(seq, i, {K}) AS w FROM (SELECT seq, unnest(range(1, length(seq) - {K} + 2)) AS i FROM reads))))",
        "SELECT r AS mult_bin, CAST(CASE WHEN r = 0 THEN 8 * (SELECT n FROM nk) - (SELECT count(*) FROM arcs0) ELSE coalesce(n, 0) END AS BIGINT) AS n FROM range(1000) t(r) LEFT JOIN bins ON b = r",
    ),
    "arc_cutoff": q(AT.ARCS, "SELECT src AS kmer, arc_idx, mult FROM arcs"),
    "node_degree_class": q(AT.ARCS, "SELECT src, right_degree, left_degree, CASE WHEN right_degree = 1 AND left_degree = 1 THEN 'semi_extended' WHEN right_degree + left_degree = 1 THEN 'end' WHEN right_degree + left_degree > 2 THEN 'branch' ELSE 'other' END AS degree_class FROM deg"),
    "semi_extended_nodes": q(AT.ARCS, "SELECT src FROM deg WHERE right_degree = 1 AND left_degree = 1"),
    "graph_statistics": q(
        f"{AT.ARCS}, node AS (SELECT src, count(*) AS d, min(mult) AS lo, max(mult) AS hi FROM arcs GROUP BY src)",
        "SELECT count(*) AS node_num, CAST(sum(d) AS BIGINT) AS edge_num, CAST(sum(d) AS BIGINT) AS arc_length_sum, count(*) FILTER (d = 1) AS tips_num, count(*) FILTER (lo * 5 < hi) AS bubble_num FROM node",
    ),
    "neighbor_twin_join": q(f"{AT.ARCS}, {AT.TWIN}", "SELECT * FROM twin"),
    "kmer_adjacency": q(AT.ARCS, "SELECT src, coalesce(string_agg(dst, ' ' ORDER BY dst) FILTER (arc_idx < 4), '') AS right_next, coalesce(string_agg(dst, ' ' ORDER BY dst) FILTER (arc_idx >= 4), '') AS left_next FROM arcs GROUP BY src"),
    "edge_list": q(AT.ARCS, "SELECT src, arc_idx, dst, CAST(1 AS BIGINT) AS len, mult FROM arcs"),
    "compacted_arcs": q(AT.COMPACT, "SELECT * FROM compacted"),
    "contigs": q(AT.CONTIGS, "SELECT * FROM contigs"),
    "contig_stats": q(
        f"{AT.CONTIGS}, c AS (SELECT len, sum(len) OVER (ORDER BY len DESC ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (ORDER BY len DESC) AS r FROM contigs WHERE len >= 200)",
        "SELECT count(*) AS contig_num, CAST(coalesce(sum(len), 0) AS BIGINT) AS total_len, max(len) FILTER (upto > (SELECT sum(len) FROM c) // 2) AS n50, max(len) FILTER (upto > 5000) AS ng50, max(len) AS max_len, max(len) FILTER (r > (SELECT count(*) FROM c) // 2) AS median_len FROM c",
    ),
    "contig_numbers": q(
        f"{AT.CONTIGS}, n AS (SELECT name, seq, len, row_number() OVER (ORDER BY len DESC, seq, name) AS number FROM contigs), r AS (SELECT *, name || '_' || number AS full_name FROM n)",
        "SELECT number, full_name AS name, len, CAST(coalesce(sum(length(full_name) + len + 3) OVER (ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM r",
    ),
    "nx_curve": q(
        f"{AT.CONTIGS}, c AS (SELECT len, sum(len) OVER (ORDER BY len DESC ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (ORDER BY len DESC) AS r FROM contigs WHERE len >= 200), x AS (SELECT CAST(x AS INTEGER) AS x FROM range(10, 100, 10) t(x))",
        "SELECT x, max(len) FILTER (upto > (SELECT sum(len) FROM c) * x // 100) AS nx, min(r) FILTER (upto > (SELECT sum(len) FROM c) * x // 100) AS lx FROM x LEFT JOIN c ON true GROUP BY x",
    ),
    "graph_reloaded": q(AT.COMPACT, "SELECT * REPLACE (mult * len AS cov) FROM compacted"),
    "arcs_streamed": q(AT.ARCS0, "SELECT * FROM arcs0"),
    "kmer_sketches": q(
        AT.READS.replace("SELECT doc_id AS doc_id", "SELECT source, doc_id AS doc_id").replace("SELECT doc_id || '/'", "SELECT source, doc_id || '/'")
        + f", occ AS (SELECT DISTINCT source, greatest(w, {rc('w')}) AS kmer FROM (SELECT source, substr(seq, i, {K}) AS w FROM (SELECT source, seq, unnest(range(1, length(seq) - {K} + 2)) AS i FROM reads)))",
        "SELECT source, count(*) AS n_kmers, (SELECT count(DISTINCT kmer) FROM occ) AS n_all, true AS near, true AS all_near FROM occ GROUP BY source",
    ),
    "sql_arc_slots": q(AT.ARCS0, "SELECT arc_idx, count(*) AS n, CAST(sum(mult) AS BIGINT) AS total FROM arcs0 GROUP BY arc_idx"),
    "sql_first_arcs": q(
        f"{AT.ARCS0}, f AS (SELECT substr(seq, 1, {K}) AS w, substr(seq, {K + 1}, 1) AS b FROM reads WHERE length(seq) > {K})",
        f"SELECT kmer, arc_idx, n, mult FROM (SELECT greatest(w, {rc('w')}) AS kmer, CAST(instr('ACGT', b) - 1 + CASE WHEN w >= {rc('w')} THEN 0 ELSE 4 END AS INTEGER) AS arc_idx, count(*) AS n FROM f GROUP BY ALL) JOIN arcs0 USING (kmer, arc_idx)",
    ),
    "sql_contig_ends": q(AT.CONTIGS, f"SELECT name, greatest(left(seq, {K}), {rc(f'left(seq, {K})')}) AS first_kmer, greatest(right(seq, {K}), {rc(f'right(seq, {K})')}) AS last_kmer, {rc('seq')} < seq AS turned FROM contigs"),
    "tips_removed": q(
        f"{AT.ARCS}, {AT.TWIN}, tip AS (SELECT src, any_value(arc_idx) AS arc_idx FROM arcs GROUP BY src HAVING count(*) = 1 AND any_value(dst) <> src), "
        "gone AS (SELECT src, arc_idx FROM tip UNION SELECT t_src, t_idx FROM twin JOIN tip USING (src, arc_idx))",
        "SELECT a.src, a.arc_idx, a.mult FROM arcs a ANTI JOIN gone g ON a.src = g.src AND a.arc_idx = g.arc_idx",
    ),
    "low_coverage_removed": q(PARTS.ARCS, "SELECT src, arc_idx, mult FROM arcs WHERE mult * 4 >= (SELECT sum(mult) // count(*) FROM arcs)"),
    "master_statistics": q(
        f"{AT.COMPACT}, node AS (SELECT src, count(*) AS d, max(len) AS longest, count(*) FILTER (arc_idx < 4) AS r, count(*) FILTER (dst = src) AS own FROM compacted GROUP BY src), {AT.PAIRS}",
        f"SELECT CAST((SELECT sum(len * mult) // sum(len) FROM compacted) AS BIGINT) AS avg_coverage, count(*) AS node_num, count(*) FILTER (d = 1 AND longest < {K}) AS tip_num, CAST(sum(own) AS BIGINT) AS loop_num, (SELECT count(*) FROM pairs3) AS multiple_edge_num, "
        "(SELECT count(*) FROM pairs3 p JOIN node x ON x.src = p.src JOIN node y ON y.src = p.dst WHERE x.d = 3 AND y.d = 3) AS resolvable_num, count(*) FILTER (r * 2 = d) AS cross_num FROM node",
    ),
    "parallel_edges": q(f"{AT.COMPACT}, {AT.PAIRS}", "SELECT * FROM pairs3"),
    "partition_histogram": q(
        f"{AT.KMERS}, s AS (SELECT least(kmer, {rc('kmer')}) AS small FROM kmers)",
        f"SELECT CAST(({_PACKED}) % 4294967296 % 24 AS BIGINT) AS part, count(*) AS n FROM s GROUP BY 1",
    ),
    "unique_sides": q(AT.ARCS, "SELECT src, " + ", ".join(
        f"CASE WHEN count(*) FILTER ({at}) = 1 THEN max({c}) FILTER ({at}) END AS {side}_{c}" for side, at in (("right", "arc_idx < 4"), ("left", "arc_idx >= 4")) for c in ("seq", "mult", "dst")) + " FROM arcs GROUP BY src"),
    "bubble_pop": q(BUBBLES, f"SELECT x.src AS src, x.arc_idx AS arc_idx, x.os || x.seq AS seq FROM win"),
    "loop_unroll": q(LOOPS, MOTIF.EDITED),
    "repeat_linearise": q(REPEATS, MOTIF.EDITED),
    "cross_edge": q(CROSSES, MOTIF.EDITED),
    "cross_node": q(CROSSINGS, MOTIF.EDITED),
}
