"""Quality rules: counted rules, and robust multivariate outliers per language and source.

measure() counts words, symbols, repeated lines and repeated three-word windows of whole texts. A transformed vector of
such statistics is then held against its group (language and source), and rows at a large Mahalanobis distance go.
Location and scatter are minimum-covariance-determinant estimates: the mean and covariance of the SUPPORT of a group's
rows whose covariance has the least determinant. They are sought from several starts. A hash draws some DRAWN rows of each
group; of many small subsets of those, concentrated on the drawn rows, the CARRIED best go on, beside the classical mean
and covariance. All starts are then concentrated on all rows until no determinant falls any more, and the least wins.
Every such step is one aggregation over the small vectors; the cut that keeps the nearest rows of a group comes from a
histogram of its distances, whose last bin counts in part, so no group is ever sorted or gathered. Groups with fewer than
MIN_GROUP rows that pass the counted rules take the estimates of their language, and languages with fewer those of all
rows. All three levels are fitted together.

CUT is set wide, as statistics of texts have heavier tails than a Gaussian, of whose rows it would reject one in 1e11.

Nulls are empty texts; null languages and sources are groups of their own. Rows that fail the counted rules neither shape
the estimates nor are kept. Repeated rows count as often as they occur; other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import SPACE, doc_text, mix, text_slices, word_hashes, words
from loomgraph.plans.session import discard, stored

MIN_WORDS = 50
#: Share of the rows that the estimates rest on, most concentration steps, the fall of a log determinant that ends them, and the floor of each scale: on scales that are
#: logarithms, a difference of some 15 % is never remarkable, however alike the rows of a group are.
SUPPORT = 0.75
STEPS = 10
TOLERANCE = 1e-3
FLOOR = 0.15
MIN_GROUP = 50
#: Rows of a group that starts are sought among, subsets tried there, and starts carried on.
DRAWN = 300
SUBSETS = 120
CARRIED = 3
#: Squared distance beyond which a row goes, and bins of the distance histogram to a factor of two.
CUT = 60.0
BINS = 16

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[*b"#*$%&|<>"]] = True
STOPS = np.zeros(256, bool)
STOPS[[*b".,;:!?"]] = True
DIGITS = np.zeros(256, bool)
DIGITS[0x30:0x3A] = True

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_stops", "n_digits")
VECTOR = ("x0", "x1", "x2", "x3", "x4")


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _grouped(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by document and key, and which places in it repeat the key before them in the same document."""
    order = np.argsort(mix(key ^ mix(doc.astype(np.uint64) + np.uint64(1))))
    k, d = key[order], doc[order]
    again = np.zeros(len(order), bool)
    again[1:] = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    return order, again


def measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """COUNTS of each document, as an array (documents, counts)."""
    n = len(offsets) - 1
    starts, ends, firsts = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    n_words = np.diff(firsts)
    inside = ~SPACE[data]
    chars = _sums(inside & ((data & 0xC0) != 0x80), offsets)
    word_doc = np.repeat(np.arange(n), n_words)

    # lines: from a document's start or behind a \n, to the next \n or the document's end
    breaks = np.flatnonzero(data == 10)
    begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    line_doc = np.searchsorted(offsets, begin, "right") - 1
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=total[1:])
    full = np.flatnonzero((end > begin) & (total[np.minimum(end, len(data))] > total[np.minimum(begin, len(data))]))
    order, again = _grouped(word_hashes(data, begin[full], end[full]), line_doc[full])
    dup = np.bincount(line_doc[full][order][again], minlength=n)

    covered = np.zeros(len(hashes), bool)
    if len(hashes) >= 3:
        at = np.flatnonzero(word_doc[2:] == word_doc[:-2])
        key = mix(hashes[at] * np.uint64(3) + mix(hashes[at + 1] * np.uint64(5) + mix(hashes[at + 2])))
        order, again = _grouped(key, word_doc[at])
        twice = again.copy()
        twice[:-1] |= again[1:]
        found = at[order[twice]]
        for k in range(3):
            covered[found + k] = True
    repeat = np.bincount(word_doc[covered], minlength=n)
    order, again = _grouped(hashes, word_doc)
    distinct = n_words - np.bincount(word_doc[order][again], minlength=n)
    return np.stack([n_words, chars, _sums(SYMBOLS[data], offsets), dup, repeat, distinct, _sums(STOPS[data], offsets), _sums(DIGITS[data], offsets)], 1)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and COUNTS of each row."""

    def run(batches):
        for batch in batches:
            got = np.concatenate([np.zeros((0, len(COUNTS)), np.int64), *(measures(data, offsets) for _, _, data, offsets in text_slices(batch.column(1)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *(pa.array(got[:, k].astype(np.int64)) for k in range(len(COUNTS)))], ["doc_id", "lang", "source", *COUNTS])

    group = [F.col(c).cast("string").alias(c) for c in ("lang", "source")]
    return doc_text(docs, *group).mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    """Statistics on scales that are near-symmetric: log mean word length, and log shares with a floor."""
    share = lambda c, low: F.log(F.col(c) / F.greatest(F.col("n_words"), F.lit(1)) + low)
    return [
        F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)).alias("x0"),
        share("n_symbols", 0.05).alias("x1"),
        share("n_stops", 0.2).alias("x2"),
        share("n_digits", 0.5).alias("x3"),
        share("n_repeat_words", 0.5).alias("x4"),
    ]


KEYS = ("g", "h")


def _moments() -> list[Column]:
    d = len(VECTOR)
    return [F.count("*").alias("n"), *(F.sum(x).alias(f"s_{x}") for x in VECTOR), *(F.sum(F.col(VECTOR[a]) * F.col(VECTOR[b])).alias(f"q_{a}_{b}") for a in range(d) for b in range(a, d))]


_SUMS = [f"s_{x}" for x in VECTOR] + [f"q_{a}_{b}" for a in range(len(VECTOR)) for b in range(a, len(VECTOR))]
_ESTIMATE = "g string, h string, start int, m array<double>, w array<double>, logdet double"


def _solved(n: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, inverse scatters and log determinants from moments, with a floor under each scale."""
    d = len(VECTOR)
    mean = sums[:, :d] / n[:, None]
    cov = np.zeros((len(n), d, d))
    for k, (a, b) in enumerate((a, b) for a in range(d) for b in range(a, d)):
        cov[:, a, b] = cov[:, b, a] = sums[:, d + k] / n - mean[:, a] * mean[:, b]
    cov += np.eye(d) * FLOOR**2
    return mean, np.linalg.inv(cov), np.linalg.slogdet(cov)[1]


def _estimate_rows(keys: list[pa.Array], start: np.ndarray, mean: np.ndarray, inverse: np.ndarray, logdet: np.ndarray) -> pa.RecordBatch:
    lists = [pa.array(list(x.reshape(len(start), -1)), pa.list_(pa.float64())) for x in (mean, inverse)]
    return pa.RecordBatch.from_arrays([*keys, pa.array(start.astype(np.int32)), *lists, pa.array(logdet)], ["g", "h", "start", "m", "w", "logdet"])


def _classical(moments: DataFrame) -> DataFrame:
    """Start 0 of each group, from its moments."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                get = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float)  # noqa: B023, E731
                yield _estimate_rows([batch.column(0), batch.column(1)], np.zeros(batch.num_rows), *_solved(get("n"), np.stack([get(c) for c in _SUMS], 1)))

    return moments.select(*KEYS, "n", *_SUMS).mapInArrow(run, _ESTIMATE)


def subset_starts(x: np.ndarray, seed: int, subsets: int = SUBSETS, carried: int = CARRIED, steps: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means, inverse scatters and log determinants of the best starts among the rows of x.

    Subsets of one row more than there are dimensions are concentrated on x: twice each, then the best ten to the end.
    """
    n, d = x.shape
    rng = np.random.default_rng(seed)
    rows = np.stack([rng.permutation(n)[: d + 1] for _ in range(subsets)])
    keep = max(min(n, d + 1), int(np.ceil(n * SUPPORT)))

    def estimate(rows):
        part = x[rows]
        mean = part.mean(1)
        off = part - mean[:, None]
        cov = off.transpose(0, 2, 1) @ off / part.shape[1] + np.eye(d) * FLOOR**2
        return mean, np.linalg.inv(cov), np.linalg.slogdet(cov)[1]

    def concentrate(rows):
        mean, inverse, _ = estimate(rows)
        off = x[None] - mean[:, None]
        return np.argsort(np.einsum("snd,sde,sne->sn", off, inverse, off), 1, kind="stable")[:, :keep]

    rows = concentrate(concentrate(rows))
    rows = rows[np.argsort(estimate(rows)[2], kind="stable")[:10]]
    for _ in range(steps):
        rows = concentrate(rows)
    mean, inverse, logdet = estimate(rows)
    best = np.argsort(logdet, kind="stable")
    _, first = np.unique(np.round(logdet[best], 9), return_index=True)  # equal ones are one
    best = best[first][:carried]
    return mean[best], inverse[best], logdet[best]


def _drawn_starts(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Starts 1, 2, ... of each group (sizes: g, h, n), from a hashed draw of its rows; repeated vectors count once."""
    drawn = rows.join(sizes, list(KEYS)).where(F.xxhash64("doc_id", *VECTOR) / F.lit(2.0**64) + 0.5 <= F.lit(float(DRAWN)) / F.col("n"))
    drawn = drawn.select(*KEYS, *VECTOR).distinct()

    def run(table: pa.Table) -> pa.Table:
        x = np.stack([table[c].to_numpy() for c in VECTOR], 1)
        if len(x) <= len(VECTOR):
            return _no_rows()
        x = x[np.lexsort(x.T)]
        mean, inverse, logdet = subset_starts(x, len(x))
        keys = [pa.array([table[k][0].as_py()] * len(mean), pa.string()) for k in KEYS]
        return pa.Table.from_batches([_estimate_rows(keys, np.arange(1, len(mean) + 1), mean, inverse, logdet)])

    return drawn.groupBy(*KEYS).applyInArrow(run, _ESTIMATE)


def _no_rows() -> pa.Table:
    doubles = pa.list_(pa.float64())
    kinds = {"g": pa.string(), "h": pa.string(), "start": pa.int32(), "m": doubles, "w": doubles, "logdet": pa.float64()}
    return pa.table({k: pa.array([], kind) for k, kind in kinds.items()})


def _distance() -> Column:
    """Squared Mahalanobis distance of a row that carries m and w."""
    d = len(VECTOR)
    off = [F.col(x) - F.col("m")[a] for a, x in enumerate(VECTOR)]
    total = F.lit(0.0)
    for a in range(d):
        for b in range(d):
            total = total + off[a] * off[b] * F.col("w")[a * d + b]
    return total


def _concentrated(rows: DataFrame, estimates: DataFrame) -> DataFrame:
    """One concentration step of every start on all rows of its group.

    The rows of a group meet its estimates by join: AQE broadcasts these where they are small and else splits hot groups.
    """
    starts = estimates.groupBy(*KEYS).agg(F.collect_list(F.struct("start", "m", "w")).alias("starts"))
    each = rows.join(starts, list(KEYS)).select(*KEYS, *VECTOR, F.explode("starts").alias("e")).select(*KEYS, *VECTOR, "e.*")
    binned = each.groupBy(*KEYS, "start", F.floor(F.log2(_distance() + 1e-6) * BINS).alias("bin")).agg(*_moments())
    binned = stored(binned, "bins")  # complete counts, so that what is dealt by group is a few hundred rows each

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bin")
        n = table["n"].to_numpy().astype(float)
        before = np.cumsum(n) - n
        part = np.clip((n.sum() * SUPPORT - before) / n, 0, 1)
        sums = np.stack([table[c].to_numpy() for c in _SUMS], 1)
        keys = [table[k][:1].combine_chunks() for k in KEYS]
        got = _solved(np.array([(n * part).sum()]), (sums * part[:, None]).sum(0, keepdims=True))
        return pa.Table.from_batches([_estimate_rows(keys, table["start"][:1].to_numpy(), *got)])

    out = stored(binned.groupBy(*KEYS, "start").applyInArrow(run, _ESTIMATE), "estimates")
    discard(binned)
    return out


def fit(rows: DataFrame, least: int = MIN_GROUP) -> DataFrame:
    """g, h, m, w, logdet: the estimates of each group of at least least rows. rows: doc_id, g, h and the vector.

    Groups with an empty h are languages, and the one with an empty g is the whole; the latter needs one row only.
    """
    moments = stored(rows.groupBy(*KEYS).agg(*_moments()).where((F.col("n") >= least) | (F.col("g") == "")), "moments")
    estimates = stored(_classical(moments).unionByName(_drawn_starts(rows, moments.select(*KEYS, "n"))), "estimates")
    for step in range(STEPS):
        after = _concentrated(rows, estimates)
        fall = estimates.select(*KEYS, "start", F.col("logdet").alias("was")).join(after, [*KEYS, "start"]).agg(F.max(F.abs(F.col("was") - F.col("logdet")))).first()[0]
        discard(estimates)
        estimates = after
        if step and (fall or 0.0) < TOLERANCE:
            break
    best = F.min_by(F.struct("m", "w", "logdet"), F.struct("logdet", "start")).alias("x")
    return estimates.groupBy(*KEYS).agg(best).select(*KEYS, "x.m", "x.w", "x.logdet")


def _with(rows: DataFrame, estimates: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their group's estimates."""
    if not keys:
        return rows.join(F.broadcast(estimates), F.lit(True), "left")  # a single row
    right = estimates.select(*(F.col(k).alias(f"_{k}") for k in keys), "m", "w")
    on = None
    for k in keys:
        same = F.col(k) == F.col(f"_{k}")
        on = same if on is None else on & same
    return rows.join(right, on, "left").drop(*(f"_{k}" for k in keys))


#: A support of three quarters of a Gaussian in five dimensions has a smaller scatter by this factor.
def consistency() -> float:
    """Support over the chance that chi-square with two more degrees of freedom stays below the support's quantile."""
    rng = np.random.default_rng(7)
    r = np.sort((rng.standard_normal((200_000, len(VECTOR))) ** 2).sum(1))
    return len(VECTOR) / r[: int(len(r) * SUPPORT)].mean()


def judge(docs: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance of each row."""
    rows = stored(measure(docs), "statistics").withColumn("base_failed", failed())
    # null languages and sources are groups too; the prefix keeps them apart from any name
    rows = rows.select("*", *vector()).withColumns({k: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")) for k, c in (("g", "lang"), ("h", "source"))})
    levels = F.array(*(F.struct(g.alias("g"), h.alias("h")) for g, h in ((F.col("g"), F.col("h")), (F.col("g"), F.lit("")), (F.lit(""), F.lit("")))))
    good = rows.where(~F.col("base_failed")).select("doc_id", *VECTOR, F.explode(levels).alias("k")).select("doc_id", *VECTOR, "k.*")
    estimates = stored(fit(good), "fitted")
    factor = consistency()
    out = rows
    for level, (keys, here) in enumerate(((["g", "h"], "h <> ''"), (["g"], "g <> '' and h = ''"), ([], "g = ''"))):
        out = _with(out, estimates.where(here).select(*keys, "m", "w"), keys)
        out = out.withColumn(f"_d{level}", F.when(F.col("m").isNotNull(), _distance() / factor)).drop("m", "w")
    distance = F.coalesce("_d0", "_d1", "_d2")
    return out.select("doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= cut)).alias("kept"), distance.alias("distance"))
