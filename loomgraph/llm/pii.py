"""Personal data: base patterns, and a linear-chain conditional random field over word shapes.

The field labels white-space words with the beginning or inside of a kind, or neither. Its features are counts of digits,
letters and signs in a word, its outer characters and the word before it. It is trained on the driver from a small
labelled table (examples() makes one by rule; any table of words and labels will do) and decoded by Viterbi in numpy,
batched over all documents of a slice. Where a word's score for "neither" exceeds every other by more than transitions can
make up for, the best path is known there, so that the chain falls apart into short stretches; the result is that of
decoding whole texts.

The field's spans are added where they overlap no base span and pass a check of their kind. Nulls are empty texts without
spans; repeated rows stay rows of their own; other columns don't matter. mask() keeps all columns.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import doc_text, small_batches, text_slices, words

# fixed values: the kinds in their order, and the base patterns
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match that begins inside a run of digits would need one that ended there, which greedy matching rules out
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for c in digits[-2::-2])) % 10 == 0


def octet(s: str) -> bool:
    s = s.lstrip("0")
    return len(s) < 3 or (len(s) == 3 and s <= "255")


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, from each @ to both sides, so that no run of letters is read twice."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        if m := DOMAIN.match(text, at + 1):
            start = at
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                free = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [("email", s, e) for s, e in emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(octet, m.groups()))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


# ---- features ----

STATES = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
#: Upper ends of the classes of digits and of letters in a word; dots, dashes and the like count up to 3.
DIGIT_STEPS = np.array([0, 1, 2, 3, 4, 6, 9, 12, 15, 19])
LETTER_STEPS = np.array([0, 1, 3, 8])
CUES = ("email", "e-mail", "mail", "phone", "tel", "call", "fax", "mobile", "card", "visa", "ip", "host", "kontakt", "contact", "correo", "courriel", "telefon", "tarjeta", "carte", "karte")

CLASS = np.zeros(256, np.int8)  # of an outer character
CLASS[0x30:0x3A], CLASS[0x41:0x5B], CLASS[0x61:0x7B], CLASS[0x80:] = 1, 2, 3, 3
for _c, _k in ((b"+", 4), (b"(", 5), (b")", 6), (b".,;:!?", 7)):
    CLASS[[*_c]] = _k
N_CLASS = 8
_SIGNS = (b"@", b".", b"-", b"/:")
_CUE_TRIM = b".,:;()"


def _count(data: np.ndarray, chars: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    mask = np.zeros(256, np.uint8)
    mask[[*chars]] = 1
    total = np.zeros(len(data) + 1, np.int32)
    np.cumsum(mask[data], out=total[1:])
    return total[ends] - total[starts]


SHAPES = (len(DIGIT_STEPS) + 1) * (len(LETTER_STEPS) + 1) * 4 ** len(_SIGNS)
TABLES = (SHAPES, N_CLASS * N_CLASS, len(CUES) + 1, (len(DIGIT_STEPS) + 1) * 2, (len(DIGIT_STEPS) + 1) * 2)


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Five categories of each word: its shape, its outer characters, the cue before it, and its neighbours' digits."""
    n = len(starts)
    digits = np.searchsorted(DIGIT_STEPS, _count(data, bytes(range(0x30, 0x3A)), starts, ends))
    letters = np.searchsorted(LETTER_STEPS, _count(data, bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 256)]), starts, ends))
    shape = digits * (len(LETTER_STEPS) + 1) + letters
    for signs in _SIGNS:
        shape = shape * 4 + np.minimum(3, _count(data, signs, starts, ends))
    outer = CLASS[data[starts]].astype(np.int64) * N_CLASS + CLASS[data[ends - 1]]
    number = digits * 2 + (letters > 0)
    cue = np.zeros(n, np.int64)
    around = np.zeros((n, 2), np.int64)
    if n > 1:
        inner = np.ones(n, bool)
        inner[firsts[:-1][firsts[:-1] < n]] = False
        look = np.flatnonzero(inner & ((digits > 0) | (shape % 4**len(_SIGNS) >= 64)))  # words with a digit or an @
        for k in look.tolist():
            w = data[starts[k - 1] : ends[k - 1]].tobytes().lower().strip(_CUE_TRIM) if ends[k - 1] - starts[k - 1] <= 12 else b""
            cue[k] = _CUE_INDEX.get(w, 0)
        around[1:, 0] = np.where(inner[1:], number[:-1], 0)
        around[:-1, 1] = np.where(inner[1:], number[1:], 0)
    return np.stack([shape, outer, cue, around[:, 0], around[:, 1]], 1)


_CUE_INDEX = {c.encode(): k + 1 for k, c in enumerate(CUES)}


# ---- the field ----


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Field:
    """Weights per feature value and state, and of transitions; a sequence begins and ends beside state O."""

    def __init__(self):
        s = len(STATES)
        self.tables = [np.zeros((n, s)) for n in TABLES]
        self.bias, self.moves = np.zeros(s), np.zeros((s, s))

    def emissions(self, f: np.ndarray) -> np.ndarray:
        out = np.broadcast_to(self.bias, (len(f), len(STATES))).copy()
        for k, t in enumerate(self.tables):
            out += t[f[:, k]]
        return out

    def _gradient(self, f: np.ndarray, y: np.ndarray):
        """f (batch, steps, features), y (batch, steps): gradient of the mean log likelihood, by forward-backward."""
        b, t, _ = f.shape
        s = len(STATES)
        e = self.emissions(f.reshape(b * t, -1)).reshape(b, t, s)
        fwd, bwd = np.zeros((b, t, s)), np.zeros((b, t, s))
        fwd[:, 0] = e[:, 0] + self.moves[0]
        for i in range(1, t):
            fwd[:, i] = e[:, i] + _logsumexp(fwd[:, i - 1, :, None] + self.moves, 1)
        bwd[:, -1] = self.moves[:, 0]
        for i in range(t - 2, -1, -1):
            bwd[:, i] = _logsumexp(self.moves + (e[:, i + 1] + bwd[:, i + 1])[:, None], 2)
        z = _logsumexp(fwd[:, -1] + bwd[:, -1], 1)
        p = np.exp(fwd + bwd - z[:, None, None])
        d = np.eye(s)[y] - p
        tables = []
        for k, table in enumerate(self.tables):
            g = np.zeros_like(table)
            np.add.at(g, f[..., k].ravel(), d.reshape(b * t, s))
            tables.append(g)
        moves = np.zeros((s, s))
        for i in range(1, t):
            q = np.exp(fwd[:, i - 1, :, None] + self.moves + (e[:, i] + bwd[:, i])[:, None] - z[:, None, None])
            moves -= q.sum(0)
        np.add.at(moves, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        moves[0] += d[:, 0].sum(0)
        moves[:, 0] += d[:, -1].sum(0)
        return [*tables, d.sum((0, 1)), moves]

    def train(self, sentences: list[tuple[np.ndarray, np.ndarray]], rounds: int = 100, rate: float = 0.3, decay: float = 1e-4) -> Field:
        """Full-batch Adam over sentences (features, states), grouped by length."""
        groups: dict[int, list] = {}
        for f, y in sentences:
            if len(f):
                groups.setdefault(len(f), []).append((f, y))
        groups = {n: (np.stack([f for f, _ in g]), np.stack([y for _, y in g])) for n, g in groups.items()}
        params = [*self.tables, self.bias, self.moves]
        m, v = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
        total = sum(len(g[0]) for g in groups.values())
        for t in range(1, rounds + 1):
            grads = [-decay * x for x in params]
            for f, y in groups.values():
                for g, x in zip(grads, self._gradient(f, y), strict=True):
                    g += x / total
            for x, g, a, b in zip(params, grads, m, v, strict=True):
                a *= 0.9
                a += 0.1 * g
                b *= 0.99
                b += 0.01 * g * g
                x += rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
        return self

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best states of a batch (batch, steps, states)."""
        b, t, s = e.shape
        best, back = e[:, 0] + self.moves[0], np.zeros((b, t, s), np.int8)
        for i in range(1, t):
            through = best[:, :, None] + self.moves
            back[:, i] = through.argmax(1)
            best = through.max(1) + e[:, i]
        out = np.zeros((b, t), np.int8)
        out[:, -1] = (best + self.moves[:, 0]).argmax(1)
        for i in range(t - 1, 0, -1):
            out[:, i - 1] = back[np.arange(b), i, out[:, i]]
        return out

    def decode(self, f: np.ndarray, firsts: np.ndarray, whole: bool = False) -> np.ndarray:
        """Best states of all words; firsts has each document's first word. whole: without cutting at certain words."""
        out = np.zeros(len(f), np.int8)
        if not len(f):
            return out
        e = self.emissions(f)
        # the most that a path can gain by another state than O between any two neighbours
        gain = (self.moves - self.moves[:, :1]).max(0) + (self.moves - self.moves[:1]).max(1)
        certain = (e[:, :1] - e[:, 1:] > gain[1:]).all(1)
        if whole:
            certain[:] = False
        open_ = np.flatnonzero(~certain)
        if not len(open_):
            return out
        doc = np.searchsorted(firsts, open_, "right")
        cut = np.flatnonzero((np.diff(open_) > 1) | (np.diff(doc) > 0)) + 1
        begin = open_[np.concatenate([[0], cut])]
        length = np.diff(np.concatenate([[0], cut, [len(open_)]]))
        for n in np.unique(length):
            rows = begin[length == n]
            step = max(1, 200_000 // int(n))
            for i in range(0, len(rows), step):
                at = rows[i : i + step, None] + np.arange(n)
                out[at] = self.viterbi(e[at])
        return out


# ---- the labelled table ----


def examples(n: int = 900, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """A small labelled table (words, states): invented prose, personal data in many forms, and numbers that are none."""
    rng = np.random.default_rng(seed)
    r = lambda a, b: int(rng.integers(a, b))
    pick = lambda x: x[r(0, len(x))]
    digits = lambda k: "".join(str(r(0, 10)) for _ in range(k))
    name = lambda: "".join(pick("aeioulnrstdm") for _ in range(r(2, 9)))

    def card(sep: str) -> str:
        d = digits(15)
        d += next(str(k) for k in range(10) if luhn(d + str(k)))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    octets = lambda: ".".join(str(r(0, 256)) for _ in range(4))
    makers = {
        "email": (lambda: f"{name()}.{digits(2)}@{name()}.{pick(('com', 'org', 'de'))}", lambda: f"{name()}@{name()}.example.com"),
        "ip": (octets, lambda: f"{octets()}:{r(80, 9000)}", lambda: f"[{octets()}]"),
        "card": (lambda: card(" "), lambda: card("-"), lambda: card(""), lambda: card("."), lambda: card("/")),
        "phone": (lambda: f"+{r(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"+{r(1, 99)} {digits(3)} {digits(6)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"00{r(1, 99)} {digits(3)} {digits(7)}"),
    }
    none = (lambda: digits(r(1, 7)), lambda: f"{r(1900, 2100)}-{r(1, 13):02}-{r(1, 29):02}", lambda: f"{r(1, 20)}.{r(0, 20)}.{r(0, 20)}", lambda: f"{r(0, 999)}.{digits(2)}", lambda: f"({r(1, 99)})", lambda: f"{r(0, 24)}:{digits(2)}", lambda: "".join(pick("0123456789abcdef") for _ in range(r(16, 40))), lambda: f"{digits(r(1, 3))}%", lambda: f"@{name()}", lambda: f"{name()}-{name()}", lambda: f"{digits(2)}/{digits(2)}/{digits(4)}", lambda: "AKIA" + "".join(pick("ABCDEF234567") for _ in range(16)), lambda: f"{digits(3)},{digits(3)}", lambda: digits(r(10, 16)), lambda: "|", lambda: f"v{r(1, 9)}.{r(0, 9)}", lambda: f"{name()}()")
    out = []
    for _ in range(n):
        tokens: list[str] = []
        states: list[str] = []
        for _ in range(r(1, 4)):
            for _ in range(r(0, 9)):
                w = name() + pick(("", "", "", ",", "."))
                tokens.append(w.capitalize() if r(0, 5) == 0 else w)
                states.append("O")
            if r(0, 2):
                kind = pick(KINDS)
                if r(0, 3) == 0:
                    tokens.append(pick({"email": ("email:", "mail", "contact"), "ip": ("ip", "host:"), "card": ("card:", "visa", "carte"), "phone": ("phone:", "tel", "call", "fax:")}[kind]))
                    states.append("O")
                made = pick(makers[kind])().split()
                made[-1] += pick(("", "", "", ",", ".", "!!", "###"))
                tokens += made
                states += [f"B-{kind}", *[f"I-{kind}"] * (len(made) - 1)]
            else:
                tokens.append(pick(none)())
                states.append("O")
        out.append((tokens, states))
    return out


def encoded(tokens: list[str], states: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(" ".join(tokens).encode(), np.uint8)
    starts, ends, firsts = words(data, np.array([0, len(data)]))
    return features(data, starts, ends, firsts), np.array([STATES.index(s) for s in states])


@functools.lru_cache(maxsize=1)
def trained() -> Field:
    return Field().train([encoded(*x) for x in examples()])


# ---- spans ----

_TRIM = b".,;:!?\"'[]{}<>#*$%&|"


def accepted(kind: str, s: str) -> bool:
    d = digits_of(s)
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", s))
    if kind == "ip":
        return bool(m := re.fullmatch(r"(\d+)\.(\d+)\.(\d+)\.(\d+)(?::\d+)?", s)) and all(map(octet, m.groups()))
    if kind == "card":
        return 16 <= len(d) <= 19 and luhn(d) and not re.search(r"[^0-9 ./-]", s)
    return 9 <= len(d) <= 15 and bool(re.search(r"[() -]", s)) and not re.search(r"[^0-9 ()./+-]", s)


def field_spans(field: Field, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[str, int, int]]]:
    """Per document with any, (kind, start, end) in bytes of it."""
    starts, ends, firsts = words(data, offsets)
    states = field.decode(features(data, starts, ends, firsts), firsts)
    out: dict[int, list[tuple[str, int, int]]] = {}
    hit = np.flatnonzero(states)
    doc = np.searchsorted(firsts, hit, "right") - 1
    run: list = []
    for k, d in zip(hit.tolist(), doc.tolist(), strict=True):
        kind, begins = (int(states[k]) - 1) // 2, (int(states[k]) - 1) % 2 == 0
        if run and run[0] == d and run[1] == kind and run[3] == k - 1 and not begins:
            run[3] = k
        else:
            if run:
                out.setdefault(run[0], []).append((KINDS[run[1]], int(starts[run[2]]), int(ends[run[3]])))
            run = [d, kind, k, k]
    if run:
        out.setdefault(run[0], []).append((KINDS[run[1]], int(starts[run[2]]), int(ends[run[3]])))
    return {d: [(kind, s - int(offsets[d]), e - int(offsets[d])) for kind, s, e in x] for d, x in out.items()}


def all_spans(text: str, raw: bytes, base: list[tuple[str, int, int]], found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans and the accepted ones of the field, in code points."""
    out = list(base)
    for kind, s, e in found:
        part = raw[s:e]
        s += len(part) - len(part.lstrip(_TRIM))
        e -= len(part) - len(part.rstrip(_TRIM))
        if s < e and accepted(kind, raw[s:e].decode("utf-8", "replace")):
            a = len(raw[:s].decode("utf-8", "replace"))
            b = a + len(raw[s:e].decode("utf-8", "replace"))
            if not any(a < f and g < b for _, g, f in base):
                out.append((kind, a, b))
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


def _per_text(field: Field, column: pa.Array):
    """(text, base spans, all spans) of each row."""
    for i, j, data, offsets in text_slices(column):
        found = field_spans(field, data, offsets)
        whole = data.tobytes()
        for k in range(j - i):
            raw = whole[offsets[k] : offsets[k + 1]]
            text = raw.decode("utf-8", "replace")
            base = base_spans(text)
            yield text, base, all_spans(text, raw, base, found[k]) if k in found else base


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def detect(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans of each row."""
    shipped = docs.sparkSession.sparkContext.broadcast(field or trained())

    def run(batches):
        for batch in batches:
            got = [([sum(1 for b in base if b[0] == k) for k in KINDS], joined(base), joined(spans)) for _, base, spans in _per_text(shipped.value, batch.column(1))]
            counts = [pa.array([x[0][k] for x in got], pa.int64()) for k in range(len(KINDS))]
            sha = pa.array([hashlib.sha256(x[1].encode()).hexdigest() for x in got], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, sha, pa.array([x[2] for x in got], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return doc_text(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by its kind; overlapping spans become one, under the first one's kind."""
    out, at = [], 0
    for s, e, kind in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """The table with personal data in text replaced by <kind>; a null text stays null, n_chars follows where it is there."""
    shipped = docs.sparkSession.sparkContext.broadcast(field or trained())
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            column = batch.column(at)
            texts = [masked(t, spans) for t, _, spans in _per_text(shipped.value, column.fill_null(""))]
            new = pa.array([t if v else None for t, v in zip(texts, column.is_valid().to_pylist(), strict=True)], column.type)
            yield pa.RecordBatch.from_arrays([new if k == at else batch.column(k) for k in range(batch.num_columns)], batch.schema.names)

    out = small_batches(docs).mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
