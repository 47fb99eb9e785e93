"""Language identification by a byte convolutional network in numpy.

Texts are cut into windows of WINDOW bytes. Filters of several widths run over the embedded bytes, each filter keeps its
maximum in a window, and a softmax over those gives the window's languages; a document's score is the mean over all its
windows, weighted by their bytes. As a filter is linear in the bytes, its response is a sum of two-byte table entries, so
that a window costs a few look-ups per filter and byte.

The network learns from a bounded sample of labelled rows of each language: those with the smallest hashes of doc_id and text,
at most ROWS_PER_LANGUAGE and at most LABELLED_ROWS over all languages (but at least one of each), and WINDOWS_PER_ROW
windows of each, spread over the text and cut out before they come to the driver. Rows that repeat in full count once there.
Every language with a labelled row that has a text is learned. The network is applied to every window of every text.

A null text, or one without a letter, is "und" with score 0. Without labelled rows every text is. Ties go to the language
that sorts first. Repeated rows stay rows of their own; other columns are never read. keep() drops rows that are "und" or
score below a bound, and leaves all others as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import buffer, doc_text, few, row_identity, slices, small_batches
from loomgraph.plans.session import stored

WINDOW = 256
WIDTHS = (2, 4)
FILTERS = 8
EMBEDDING = 8
ROWS_PER_LANGUAGE = 300
LABELLED_ROWS = 20_000
WINDOWS_PER_ROW = 4
EPOCHS = 6
#: keep() wants one language to get at least this share of a text.
MIN_SCORE = 0.5
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")


class ByteCNN:
    """Embedding (256, e); per width a filter bank (width*e, f) and bias; softmax over all filters' maxima."""

    def __init__(self, languages: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.p = {"E": rng.normal(0, 0.3, (256, EMBEDDING))}
        for w in WIDTHS:
            self.p[f"F{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["W"] = rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(languages)))
        self.p["c"] = np.zeros(len(languages))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        e = p["E"][x]
        pooled, where = [], {}
        for w in WIDTHS:
            cols = np.concatenate([e[:, k : x.shape[1] - w + 1 + k] for k in range(w)], 2)
            r = cols @ p[f"F{w}"] + p[f"b{w}"]
            where[w] = (cols, r.argmax(1))
            pooled.append(np.maximum(r.max(1), 0))
        h = np.concatenate(pooled, 1)
        z = h @ p["W"] + p["c"]
        z -= z.max(1, keepdims=True)
        q = np.exp(z)
        q /= q.sum(1, keepdims=True)
        q[np.arange(n), y] -= 1
        q /= n
        g = {"W": h.T @ q, "c": q.sum(0), "E": np.zeros_like(p["E"])}
        dh = (q @ p["W"].T) * (h > 0)
        for i, w in enumerate(WIDTHS):
            cols, at = where[w]
            d = dh[:, i * FILTERS : (i + 1) * FILTERS]
            picked = cols[np.arange(n)[:, None], at]  # n, filters, width*embedding
            g[f"F{w}"] = np.einsum("nfd,nf->df", picked, d)
            g[f"b{w}"] = d.sum(0)
            back = (d[:, :, None] * p[f"F{w}"].T[None]).reshape(n, FILTERS, w, EMBEDDING)
            for k in range(w):
                np.add.at(g["E"], x[np.arange(n)[:, None], at + k], back[:, :, k])
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01, seed: int = 2) -> ByteCNN:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                part = order[i : i + batch]
                t += 1
                for k, g in self.gradients(x[part], y[part]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def tables(self) -> dict[int, list[np.ndarray]]:
        """Per width, a table of two-byte responses for each pair of places in the filter."""
        out = {}
        for w in WIDTHS:
            f = self.p[f"F{w}"].reshape(w, EMBEDDING, FILTERS)
            single = [self.p["E"] @ f[k] for k in range(w)]
            pairs = [(single[k][:, None] + single[k + 1][None]).reshape(65536, FILTERS).astype(np.float32) for k in range(0, w, 2)]
            out[w] = pairs
        return out

    def responses(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray, tables) -> np.ndarray:
        """Filter maxima (windows, all filters) over the places from starts to before stops; none of these is empty.

        data has at least max(WIDTHS) bytes behind the last stop; a filter reads up to its width from each place.
        """
        edges = np.stack([starts, stops], 1).ravel()
        pair = (data[:-1].astype(np.uint32) << 8) | data[1:]
        out = []
        for w in WIDTHS:
            n = len(data) - w + 1
            r = tables[w][0][pair[:n]]
            for k in range(1, w // 2):
                r += tables[w][k][pair[2 * k : 2 * k + n]]
            out.append(np.maximum(np.maximum.reduceat(r, edges, axis=0)[::2] + self.p[f"b{w}"], 0))
        return np.concatenate(out, 1)

    def scores(self, h: np.ndarray) -> np.ndarray:
        z = h @ self.p["W"] + self.p["c"]
        z -= z.max(1, keepdims=True)
        q = np.exp(z)
        return q / q.sum(1, keepdims=True)


def windows(text: bytes, how_many: int) -> list[np.ndarray]:
    """Windows of WINDOW bytes spread evenly over a text; a short text is padded with spaces."""
    n = max(1, len(text) // WINDOW)
    picks = sorted({round(k * (n - 1) / max(1, how_many - 1)) for k in range(min(n, how_many))})
    return [np.frombuffer(text[k * WINDOW : (k + 1) * WINDOW].ljust(WINDOW), np.uint8) for k in picks]


def labelled_sample(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE, total: int = LABELLED_ROWS) -> list[tuple[str, list[np.ndarray]]]:
    """The windows of the labelled rows with the smallest hashes of doc_id and text outside the held-out fold.

    Of each language at most rows, and over all languages about total, but one of each language at least.
    """
    known = docs.where(F.col("lang").isNotNull() & ~held_out() & (F.trim(F.coalesce(F.col("text").cast("string"), F.lit(""))) != ""))
    keyed = known.select(F.col("lang").cast("string").alias("lang"), row_identity().alias("h"), F.col("text").cast("string").alias("text"))
    # a bound on the hash that leaves about twice the rows, from counts alone; small languages keep all
    counts = keyed.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).withColumn("languages", F.count("*").over(Window.partitionBy(F.lit(0))))
    each = F.greatest(F.lit(1), F.least(F.lit(rows), F.floor(F.lit(total) / F.col("languages")))).alias("each")
    counts = counts.select("lang", each, "least", F.least(F.lit(1.0), (2.0 * each + 20) / F.col("n")).alias("share"))
    below = ((F.col("h") / F.lit(2.0**64) + 0.5) <= F.col("share")) | (F.col("h") == F.col("least"))
    near = keyed.join(few(stored(counts, "languages")), "lang").where(below).groupBy("lang", "each", "h").agg(F.max("text").alias("text"))
    w = Window.partitionBy("lang").orderBy("h", "text")
    picked = near.withColumn("k", F.row_number().over(w)).where(F.col("k") <= F.col("each")).select("lang", "k", "text")

    def run(batches):
        for batch in batches:
            cut = [b"".join(x.tobytes() for x in windows(t.as_buffer().to_pybytes(), WINDOWS_PER_ROW)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cut, pa.binary())], ["lang", "k", "windows"])

    got = small_batches(picked).mapInArrow(run, "lang string, k int, windows binary").toArrow().sort_by([("lang", "ascending"), ("k", "ascending")])
    return [(lang.as_py(), list(np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, WINDOW))) for lang, x in zip(got["lang"], got["windows"], strict=True)]


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> ByteCNN | None:
    sample = labelled_sample(docs, rows)
    languages = sorted({lang for lang, _ in sample})
    if not languages:
        return None
    place = {lang: k for k, lang in enumerate(languages)}
    cut = [(w, place[lang]) for lang, many in sample for w in many]
    return ByteCNN(languages).train(np.stack([w for w, _ in cut]), np.array([y for _, y in cut]))


def _document_scores(model: ByteCNN, tables, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, languages): mean over each document's windows, weighted by their bytes; zeros for an empty one."""
    lengths = np.diff(offsets)
    n_windows = -(-lengths // WINDOW)
    doc = np.repeat(np.arange(len(lengths)), n_windows)
    first = np.cumsum(n_windows) - n_windows
    start = offsets[:-1][doc] + (np.arange(len(doc)) - first[doc]) * WINDOW
    out = np.zeros((len(lengths), len(model.languages)))
    if not len(doc):
        return out
    # blanks behind each document, as training has behind short windows, so that no filter reads the next document
    room = 2 * max(WIDTHS)
    padded = np.full(len(data) + room * len(lengths), 32, np.uint8)
    padded[np.arange(len(data)) + room * np.repeat(np.arange(len(lengths)), lengths)] = data
    stop = np.minimum(start + WINDOW, offsets[1:][doc] + max(WIDTHS))
    q = model.scores(model.responses(padded, start + room * doc, stop + room * doc, tables))
    weight = np.minimum(WINDOW, offsets[1:][doc] - start)
    np.add.at(out, doc, q * weight[:, None])
    return out / np.maximum(lengths, 1)[:, None]


def _predicted(net: ByteCNN | None, tables, column: pa.Array) -> tuple[list[str], list[float]]:
    """Language and score of each text of a column without nulls."""
    data, offsets = buffer(column)
    languages, scores = [], []
    for i, j in slices(offsets, 1 << 19):
        part = data[offsets[i] : offsets[j]]
        inner = offsets[i : j + 1] - offsets[i]
        q = _document_scores(net, tables, part, inner) if net else np.zeros((j - i, 1))
        best = q.argmax(1)
        raw = part.tobytes()
        for k in range(j - i):
            text = raw[inner[k] : inner[k + 1]]
            if net and (text.upper() != text.lower() or _LETTER.search(text.decode())):
                languages.append(net.languages[best[k]])
                scores.append(float(min(1.0, q[k, best[k]])))
            else:
                languages.append(UNKNOWN)
                scores.append(0.0)
    return languages, scores


def predict(docs: DataFrame, model: ByteCNN | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        net = shipped.value
        tables = net.tables() if net else None
        for batch in batches:
            languages, scores = _predicted(net, tables, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return small_batches(doc_text(docs, held_out().alias("held_out"))).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> DataFrame:
    return predict(docs, train(docs, rows))


def keep(docs: DataFrame, least: float = MIN_SCORE, rows: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """The rows whose predicted language is known and scores at least least, with all their columns, in one pass."""
    shipped = docs.sparkSession.sparkContext.broadcast(train(docs, rows))
    at = docs.columns.index("text")

    def run(batches):
        net = shipped.value
        tables = net.tables() if net else None
        for batch in batches:
            languages, scores = _predicted(net, tables, batch.column(at).fill_null(""))
            yield batch.filter(pa.array([x != UNKNOWN and y >= least for x, y in zip(languages, scores, strict=True)], pa.bool_()))

    return small_batches(docs).mapInArrow(run, docs.schema)
