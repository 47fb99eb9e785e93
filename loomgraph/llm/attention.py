"""A causal self-attention language model in numpy, over subword ids and whole corpora.

Texts (A-Z in lower case) are cut into subword ids with a public rank file; an end id closes each text. A place's input is
the embedding of its id, that of the pair of ids that ends there (by hash), and that of its place in the window. One layer
of causal attention over the window and the last input give a state, from which a subword is predicted in two steps: its
group, then its place in the group. The most frequent ids have groups of MEMBERS with learned scores; the others are one
group, divided by their shares in all training texts (add-one smoothed). Before training the model is exactly the add-one
unigram of those counts. Both steps are proper distributions, so a text's score is a log-probability. quick_exp() stands
for exp() in all of them.

Scoring reads windows of WINDOW ids that overlap: each scores its last STEP ids, with at least WINDOW - STEP ids of context,
so that every id is scored once. Windows of many texts form one batch; attention is masked to earlier ids of the same text.

Ids are counted in all training texts, and weights are learned from all windows of them, each once, at any size of the
corpus. learn() deals the windows by hash into rounds; in a round, groups of windows train in parallel from the round's
weights, and the mean of their weights, by windows, starts the next round. What is dealt follows from the rows alone, not
from how the input is partitioned.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.bpe import encode_text
from loomgraph.llm.common import mix, small_batches
from loomgraph.plans.session import discard, freed, stored

WINDOW = 64
STEP = 48
#: Sizes of embeddings, attention keys and attention values.
SIZE, KEYS, VALUES = 24, 8, 16
GROUPS, MEMBERS = 24, 24
INPUTS, PAIRS = 4096, 8192
#: Windows in a batch, in scoring and in training.
BATCH = 128
TRAIN_BATCH = 128
#: Windows are passed on, and weights summed, in pieces of so many; weights of so many groups at a time.
PIECE = 4096
FAN_IN = 64
#: Clips what goes into quick_exp().
LIMIT = np.float32(30)
#: Columns of what a place's input is multiplied out to: its key, its query, and its value with a one behind it.
_K, _Q, _V = slice(0, KEYS), slice(KEYS, 2 * KEYS), slice(2 * KEYS, 2 * KEYS + VALUES + 1)
#: Columns of the weights of a target: those of the groups, and those of the members of its own.
_FIRST, _SECOND = slice(0, GROUPS), slice(GROUPS, GROUPS + MEMBERS)
#: Bytes of freed memory that a process may keep for its next batch.
KEPT = 30 << 20
#: Weights that Adam takes at a time, so that its steps on them stay in the cache.
ADAM = 1 << 14
#: Which of a window's inputs each of its last STEP places may look at.
_SEEN = (np.arange(WINDOW)[None] <= np.arange(WINDOW - STEP, WINDOW)[:, None]).astype(np.float32)


@dataclass(frozen=True)
class Training:
    """rounds: how often weights are averaged; group: windows that train one after another, about; rate: of the first round."""

    rounds: int = 6
    group: int = 24_576
    rate: float = 0.02


def quick_exp(x: np.ndarray) -> np.ndarray:
    """Within 4 % of exp(), positive and increasing; x, clipped by LIMIT, is overwritten. A float's bits are linear in its logarithm."""
    np.clip(x, -LIMIT, LIMIT, out=x)
    x *= np.float32(2**23 / np.log(2))
    x += np.float32(127 * 2**23 - 366_000)
    return x.astype(np.int32).view(np.float32)


def keep_freed() -> None:
    """Lets the C library keep what a batch frees for the next one, in place of handing it back and faulting it in again.

    glibc moves its bounds for that up to the largest block, below 32 MB, that was freed; this one is never touched.
    """
    np.empty(KEPT, np.uint8)


def frame_type(n_ids: int) -> type:
    """The narrowest type for ids and the two marks behind them."""
    return np.uint16 if n_ids + 2 <= 1 << 16 else np.int32


class AttentionLM:
    """counts: how often each id stands in the training texts; the last id is the end."""

    def __init__(self, counts: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.n_ids = n = len(counts)
        self.start, self.none = n, n + 1  # marks of the place before a text, and of places outside
        order = np.lexsort((np.arange(n), -counts))
        rank = np.empty(n + 2, np.int64)
        rank[order] = np.arange(n)
        rank[n:] = n
        own = (GROUPS - 1) * MEMBERS
        self.group = np.minimum(rank // MEMBERS, GROUPS - 1).astype(np.int16)
        self.member = (rank % MEMBERS).astype(np.int16)
        rest = order[own:]
        self.within = np.zeros(n + 2, np.float32)
        self.within[rest] = np.log((counts[rest] + 1.0) / (counts[rest] + 1.0).sum())
        # inputs: the most frequent ids have an embedding of their own, the rest share some by remainder
        single = INPUTS - 256
        self.input = np.where(rank < single, rank, single + rank % 255).astype(np.int32)
        self.input[n:] = INPUTS - 1
        d, h = SIZE, SIZE + VALUES
        weight = np.zeros(GROUPS)
        np.add.at(weight, self.group[:n], counts + 1.0)
        inner = np.full((GROUPS - 1, MEMBERS), 1e-9)
        top = order[:own]
        inner[self.group[top], self.member[top]] = counts[top] + 1.0
        self.p = {k: v.astype(np.float32) for k, v in {
            "E": rng.normal(0, 0.3, (INPUTS, d)), "B": np.zeros((PAIRS, d)), "P": rng.normal(0, 0.1, (WINDOW, d)),
            "Q": rng.normal(0, d**-0.5, (d, KEYS)), "K": rng.normal(0, d**-0.5, (d, KEYS)), "V": rng.normal(0, d**-0.5, (d, VALUES)),
            "O": np.zeros((h, GROUPS)), "c": _logs(weight), "M": np.zeros((GROUPS - 1, h, MEMBERS)), "m": _logs(inner),
        }.items()}

    def frames(self, ids: np.ndarray, lengths: np.ndarray, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        """(windows, WINDOW + 2) of texts of the given lengths, whose ids stand one after another, each with its end.

        A window's inputs are columns 1 to WINDOW, each with the id before it on its left; its targets are the last STEP.
        some: which of the windows to make.
        """
        text, k = (x[some] for x in windows(lengths))
        place = (k * STEP - (WINDOW - STEP) - 2)[:, None] + np.arange(WINDOW + 2)
        begin = (np.cumsum(lengths) - lengths)[text, None]
        inside = (place >= 0) & (place < lengths[text, None])
        out = np.where(inside, ids[np.clip(begin + place, 0, max(0, len(ids) - 1))] if len(ids) else 0, self.none)
        out[place == -1] = self.start
        return out.astype(np.int64)

    def _inputs(self, f: np.ndarray):
        """Inputs, pairs and live places of frames, and the places and ids of their targets by group, with the groups' edges."""
        now, before = f[:, 1:-1], f[:, :-2]
        pair = ((before * 40_503 + now * 2_654_435_761) >> 7) % PAIRS
        target = f[:, -STEP:].ravel()
        at = np.flatnonzero(target != self.none)
        at = at[np.argsort(self.group[target[at]], kind="stable")]
        y = target[at]
        return self.input[now], pair, (now != self.none).astype(np.float32), at, y, np.searchsorted(self.group[y], np.arange(GROUPS + 1))

    def _mixed(self) -> np.ndarray:
        """What inputs are multiplied by; nothing for the one behind the value."""
        w = np.zeros((SIZE, _V.stop), np.float32)
        w[:, _K], w[:, _Q], w[:, _V][:, :-1] = self.p["K"], self.p["Q"] * _ROOT, self.p["V"]
        return w

    def _forward(self, x, pair, live, w):
        """States (a one behind each) of the places of targets, and what the gradient needs: attention is s times its share."""
        p = self.p
        e = np.take(p["E"], x, axis=0)
        e += np.take(p["B"], pair, axis=0)
        e += p["P"]
        kqv = (e.reshape(-1, SIZE) @ w).reshape(*x.shape, -1)
        k, q, v = kqv[..., _K], kqv[:, -STEP:, _Q], kqv[..., _V]
        v[..., -1] = 1  # sums up the weights
        edge = np.flatnonzero(live.min(axis=1) == 0)
        v[edge] *= live[edge, :, None]
        s = quick_exp(q @ k.transpose(0, 2, 1))
        s *= _SEEN
        seen = s @ v
        share = 1 / np.maximum(seen[..., VALUES:], np.float32(1e-30))
        h = np.empty((len(x), STEP, VALUES + SIZE + 1), np.float32)
        np.multiply(seen[..., :VALUES], share, out=h[..., :VALUES])
        h[..., VALUES:-1] = e[:, -STEP:]
        h[..., -1] = 1
        return h, (e, q, k, v, s, share, edge)

    def _heads(self) -> np.ndarray:
        """What states with a one behind them are multiplied by, for each group; the last one's members have no weights."""
        p, w = self.p, np.zeros((GROUPS, VALUES + SIZE + 1, _SECOND.stop), np.float32)
        w[:, :-1, _FIRST], w[:, -1, _FIRST] = p["O"], p["c"]
        w[:-1, :-1, _SECOND], w[:-1, -1, _SECOND] = p["M"], p["m"]
        return w

    def _weights(self, h, heads, edges):
        """Weights of the groups and of the members, a row for each target's state; over their sums they are chances."""
        z = np.empty((len(h), _SECOND.stop), np.float32)
        for c in range(GROUPS):
            a, b = edges[c], edges[c + 1]
            if b > a:
                np.matmul(h[a:b], heads[c], out=z[a:b])
        return quick_exp(z)

    def _parts(self, z, y, edges):
        """The two parts of weights, and which of its columns is each target's; the last group has no members."""
        own = edges[-2]
        return (z[:, _FIRST], self.group[y]), (z[:own, _SECOND], self.member[y[:own]])

    def log_chances(self, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places (window times STEP plus place) and natural log-probabilities of all targets of frames, by group."""
        x, pair, live, at, y, edges = self._inputs(f)
        h, _ = self._forward(x, pair, live, self._mixed())
        z = self._weights(np.take(h.reshape(-1, h.shape[-1]), at, axis=0), self._heads(), edges)
        chance, inner = (w[np.arange(len(w)), index] / (w @ _ONES[: w.shape[1]]) for w, index in self._parts(z, y, edges))
        chance[: len(inner)] *= inner
        return at, np.log(chance) + self.within[y]

    def score(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Natural log-probability of each text."""
        keep_freed()
        out = np.zeros(len(lengths))
        n = -(-lengths // STEP)
        edges = np.concatenate([[0], np.cumsum(n)])
        starts = np.concatenate([[0], np.cumsum(lengths)])
        i = 0
        while i < len(lengths):
            j = max(i + 1, int(np.searchsorted(edges, edges[i] + BATCH, "right")) - 1)
            f = self.frames(ids[starts[i] : starts[j]], lengths[i:j])
            owner = np.repeat(np.arange(i, j), n[i:j])
            for a in range(0, len(f), BATCH):
                at, chance = self.log_chances(f[a : a + BATCH])
                out += np.bincount(owner[a + at // STEP], chance, minlength=len(out))
            i = j
        return out

    def train(self, frames: np.ndarray, passes: int = 1, rate: float = Training.rate, batch: int = TRAIN_BATCH, seed: int = 4) -> AttentionLM:
        """Adam over batches of frames."""
        keep_freed()
        rng = np.random.default_rng(seed)
        # moments without their factors of 0.1 and 0.01
        moments = {k: [np.zeros(w.size, np.float32) for _ in range(2)] for k, w in self.p.items()}
        t = 0
        for _ in range(passes):
            order = rng.permutation(len(frames))
            for a in range(0, len(frames), batch):
                t += 1
                root = np.sqrt(0.01 / (1 - 0.99**t))
                step, least = np.float32(0.1 * rate / (1 - 0.9**t) / root), np.float32(1e-8 / root)
                for k, g in self._gradient(frames[order[a : a + batch]]).items():
                    p, g = self.p[k].reshape(-1), g.reshape(-1)
                    for i in range(0, len(p), ADAM):
                        some = slice(i, i + ADAM)
                        m, v, d = moments[k][0][some], moments[k][1][some], g[some]
                        m *= np.float32(0.9)
                        m += d
                        v *= np.float32(0.99)
                        d *= d
                        v += d
                        np.sqrt(v, out=d)
                        d += least
                        np.divide(m, d, out=d)
                        d *= step
                        p[some] -= d
        return self

    def _gradient(self, f: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of each weight, of the mean negative log-probability."""
        x, pair, live, at, y, edges = self._inputs(f)
        w, heads = self._mixed(), self._heads()
        h, (e, q, k, v, s, share, edge) = self._forward(x, pair, live, w)
        own = np.take(h.reshape(-1, h.shape[-1]), at, axis=0)
        z = self._weights(own, heads, edges)
        scale = np.float32(1 / max(1, len(at)))
        for part, index in self._parts(z, y, edges):
            part *= (scale / (part @ _ONES[: part.shape[1]]))[:, None]
            part[np.arange(len(part)), index] -= scale
        z[edges[-2] :, _SECOND] = 0
        dh, dw = np.empty((len(own), VALUES + SIZE), np.float32), np.zeros_like(heads)
        for c in range(GROUPS):
            a, b = edges[c], edges[c + 1]
            if b > a:
                np.matmul(own[a:b].T, z[a:b], out=dw[c])
                np.matmul(z[a:b], heads[c, :-1].T, out=dh[a:b])
        first, second = dw[..., _FIRST].sum(0), dw[:-1, :, _SECOND]
        out = {"O": first[:-1], "c": first[-1], "M": second[:, :-1], "m": second[:, -1]}
        full = np.zeros((len(f) * STEP, VALUES + SIZE), np.float32)
        full[at] = dh
        full = full.reshape(len(f), STEP, -1)
        # of the weights s, by their sums; the one behind a value takes the mean off, and is none at places outside
        back = np.empty((len(f), STEP, VALUES + 1), np.float32)
        np.multiply(full[..., :VALUES], share, out=back[..., :-1])
        np.einsum("ijk,ijk->ij", back[..., :-1], h[..., :VALUES], out=back[..., -1])
        np.negative(back[..., -1], out=back[..., -1])
        ds = back @ v.transpose(0, 2, 1)
        ds *= s
        d = np.zeros((*x.shape, _V.stop - 1), np.float32)
        values = d[..., _V.start :]
        np.matmul(ds.transpose(0, 2, 1), q, out=d[..., _K])
        np.matmul(ds, k, out=d[:, -STEP:, _Q])
        np.matmul(s.transpose(0, 2, 1), back[..., :-1], out=values)
        values[edge] *= live[edge, :, None]
        moved = e.reshape(-1, SIZE).T @ d.reshape(-1, d.shape[-1])
        out |= {"K": moved[:, _K], "Q": moved[:, _Q] * _ROOT, "V": moved[:, _V]}
        de = (d.reshape(-1, d.shape[-1]) @ w[:, :-1].T).reshape(e.shape)
        de[:, -STEP:] += full[..., VALUES:]
        out |= {"P": de.sum(0), "E": _summed_rows(de, x, INPUTS), "B": _summed_rows(de, pair, PAIRS)}
        return {name: np.ascontiguousarray(g) for name, g in out.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.p.values()])

    def set_flat(self, weights: np.ndarray) -> AttentionLM:
        at = 0
        for k, w in self.p.items():
            self.p[k] = weights[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size
        return self

    def learn(self, training: DataFrame, how: Training = Training()) -> AttentionLM:
        """Trains on the encoded texts of a table with doc_id, ids (of frame_type()) and n_ids, as the module says."""
        spark = training.sparkSession
        total = training.agg(F.sum(F.ceil(F.col("n_ids") / float(STEP)))).first()[0]
        if not total:
            return self
        dealt = stored(dealt_windows(training, self, how.rounds), "windows")
        groups = max(1, round(total / how.rounds / how.group))
        for r in range(how.rounds):
            sent = spark.sparkContext.broadcast(self)
            rate = how.rate * (1 - r / how.rounds)
            here = dealt.where(F.col("round") == r).withColumn("g", F.pmod(F.xxhash64("h"), F.lit(groups)))
            sums = here.groupBy("g").applyInArrow(_trainer(sent, rate, r), _PIECES)
            parts = groups
            while parts > FAN_IN:
                parts = -(-parts // FAN_IN)
                sums = sums.withColumn("g", F.col("g") % parts).groupBy("piece", "g").applyInArrow(_summed, _PIECES)
            with freed(spark):
                got = sums.groupBy("piece").applyInArrow(_summed, _PIECES).toArrow().sort_by("piece")
            if got.num_rows:
                self.set_flat(np.concatenate([np.frombuffer(w.as_buffer(), np.float64) for w in got["w"]]) / got["n"][0].as_py())
        discard(dealt)
        return self


def _logs(weights: np.ndarray) -> np.ndarray:
    """Inputs of quick_exp() whose results are in proportion to weights, along the last axis."""
    share = weights / weights.sum(-1, keepdims=True)
    return np.log(np.maximum(share, 1e-9))


def _summed_rows(rows: np.ndarray, index: np.ndarray, n: int) -> np.ndarray:
    """(n, SIZE) sums of the rows of each index."""
    out = np.zeros(n * SIZE, np.float32)
    np.add.at(out, (index.reshape(-1, 1).astype(np.int64) * SIZE + np.arange(SIZE)).ravel(), rows.ravel())
    return out.reshape(n, SIZE)


_ONES = np.ones(max(GROUPS, MEMBERS), np.float32)
_ROOT = np.float32(KEYS**-0.5)


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window of texts of these lengths: its text, and its number in that."""
    n = -(-lengths // STEP)
    text = np.repeat(np.arange(len(lengths)), n)
    return text, np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)


def dealt_windows(training: DataFrame, model: AttentionLM, rounds: int) -> DataFrame:
    """round int, h long, frame binary: all windows of all texts, dealt by hash."""
    sent = training.sparkSession.sparkContext.broadcast((model.start, model.none))
    kind = frame_type(model.n_ids)
    cutter = AttentionLM.__new__(AttentionLM)

    def run(batches):
        cutter.start, cutter.none = sent.value
        for batch in batches:
            ids = [np.frombuffer(x.as_buffer(), kind) for x in batch.column(1)]
            lengths = np.array([len(x) for x in ids], np.int64)
            text, k = windows(lengths)
            hashes = mix(batch.column(0).to_numpy().view(np.uint64)[text] + mix(k.astype(np.uint64) + np.uint64(9)))
            flat = np.concatenate([*ids, np.zeros(0, kind)])
            for a in range(0, len(text), PIECE):
                some = slice(a, a + PIECE)
                h, f = mix(hashes[some]), cutter.frames(flat, lengths, some).astype(kind)
                rows = pa.array([x.tobytes() for x in f], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(((h >> np.uint64(40)) % np.uint64(rounds)).astype(np.int32)), pa.array(h.view(np.int64)), rows], ["round", "h", "frame"])

    return small_batches(training.select(F.xxhash64("doc_id", "ids").alias("h"), "ids")).mapInArrow(run, "round int, h long, frame binary")


_PIECES = "g long, piece int, n long, w binary"


def _trainer(sent, rate: float, r: int):
    """Trains one group's windows: pieces of the weights times the group's windows n."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        model = pickle.loads(pickle.dumps(sent.value))  # other groups of this process start from the same weights
        rows = table.sort_by([("h", "ascending"), ("frame", "ascending")])["frame"].combine_chunks()
        frames = np.frombuffer(b"".join(rows.to_pylist()), frame_type(model.n_ids)).reshape(len(rows), WINDOW + 2).astype(np.int64)
        w = model.train(frames, rate=rate, seed=4 + r).flat().astype(np.float64) * len(frames)
        pieces = [w[a : a + PIECE].tobytes() for a in range(0, len(w), PIECE)]
        n = len(pieces)
        return pa.table({"g": pa.array([key[0].as_py()] * n, pa.int64()), "piece": pa.array(range(n), pa.int32()), "n": pa.array([len(frames)] * n, pa.int64()), "w": pa.array(pieces, pa.binary())})

    return run


def _summed(table: pa.Table) -> pa.Table:
    # in one order, so that the sum is the same in each run
    total = np.sum([np.frombuffer(w, np.float64) for w in sorted(table["w"].to_pylist())], 0)
    return pa.table({"g": table["g"][:1], "piece": table["piece"][:1], "n": pa.array([sum(table["n"].to_pylist())], pa.int64()), "w": pa.array([total.tobytes()], pa.binary())})


def text_ids(library, end: int, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts with an end behind each, and their lengths."""
    out = []
    for t in texts:
        out.append(encode_text(library, t.decode("utf-8", "replace")))
        out.append(np.array([end], np.uint32))
    lengths = np.array([len(a) + 1 for a in out[::2]], np.int64)
    return np.concatenate([*out, np.zeros(0, np.uint32)]).astype(np.int64), lengths
