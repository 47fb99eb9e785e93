"""Secret scans with linking of multipart credentials.

Base patterns are reported as they stand. Weak parts (account identifiers, random-looking strings, service addresses)
say little by themselves; they are reported only when complementary parts stand together: a secret with an identifier or
an address, in one paragraph and at most REACH code points apart. The parts of all documents are linked by one interval
join: each part falls into bins of REACH code points of its document's paragraph, and meets those of its own and the
neighbouring bins. A bin holds no more parts than characters, so no key of the join can become large.

Nulls are empty texts without spans. Repeated rows stay rows of their own; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from itertools import islice, takewhile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import doc_text, row_hash
from loomgraph.plans.session import stored

REACH = 300
MIN_ENTROPY = 3.2

# fixed values: the kinds in their order, and the base patterns
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_IDENTIFIER = re.compile(r"""(?i:client_?id|access_?key_?id|user_?name|user|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.ASCII)
_RANDOM = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_=-]|\.+[A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"""\b(?:https?|ftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]{3,}""", re.ASCII)
_BLANK = re.compile(r"\n[\x20\t\r]*\n")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then kind as listed."""
    out = []
    low = text.lower() if ":" in text or "=" in text else ""
    if any(w in low for w in _WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def weak_parts(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of identifiers, random-looking strings and service addresses."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(1), m.end(1), "identifier") for m in _IDENTIFIER.finditer(text)]
        if "://" in text:
            out += [(m.start(), m.end(), "endpoint") for m in _ENDPOINT.finditer(text)]
    for m in _RANDOM.finditer(text):
        s = m[0]
        if any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and entropy(s) >= MIN_ENTROPY:
            out.append((m.start(), m.end(), "secret"))
    return out


def parts(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str, int]]]:
    """Base spans, and all parts with the number of their paragraph; a base access key identifies, other base spans
    are secrets. Weak parts that overlap a base span are that span."""
    base = base_spans(text)
    weak, k = [], 0
    for s, e, kind in sorted(weak_parts(text)):
        while k < len(base) and base[k][1] <= s:
            k += 1
        if not any(s < f for _, f, _ in takewhile(lambda b: b[0] < e, islice(base, k, None))):  # noqa: B023
            weak.append((s, e, kind))
    if not weak or len(weak) + len(base) < 2:
        return base, []
    breaks = [m.start() for m in _BLANK.finditer(text)]
    out, p = [], 0
    for s, e, kind in sorted([*base, *weak]):
        while p < len(breaks) and breaks[p] < s:
            p += 1
        out.append((s, e, kind, p))
    return base, out


def find_parts(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, rid, base array<start, end, kind>, parts array<start, end, kind, paragraph>."""
    span = pa.struct([("s", pa.int64()), ("e", pa.int64()), ("k", pa.string())])
    part = pa.struct([("s", pa.int64()), ("e", pa.int64()), ("k", pa.string()), ("p", pa.int64())])

    def run(batches):
        for batch in batches:
            raw = [t.as_buffer().to_pybytes() for t in batch.column(1)]
            got = [parts(t.decode()) for t in raw]
            base = pa.array([[{"s": s, "e": e, "k": k} for s, e, k in b] for b, _ in got], pa.list_(span))
            every = pa.array([[{"s": s, "e": e, "k": k, "p": p} for s, e, k, p in x] for _, x in got], pa.list_(part))
            sha = [hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in b).encode()).hexdigest() for b, _ in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(row_hash(raw), pa.int64()), base, every, pa.array(sha)], ["doc_id", "rid", "base", "parts", "base_sha256"])

    return doc_text(docs).mapInArrow(run, "doc_id long, rid long, base array<struct<s:long,e:long,k:string>>, parts array<struct<s:long,e:long,k:string,p:long>>, base_sha256 string")


def link(found: DataFrame) -> DataFrame:
    """doc_id, rid, s, e, k of the weak parts that have a complement within reach, by an interval join."""
    rows = found.where(F.size("parts") > 1).dropDuplicates(["doc_id", "rid"]).select(F.coalesce("doc_id", F.lit(-1)).alias("d"), "rid", F.explode("parts").alias("x"))
    rows = rows.select("d", "rid", F.col("x.p").alias("p"), F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.col("x.k").alias("k"))
    holds = F.col("k").isin("secret", "assign", "hex")  # what must stay secret; the rest says what it opens
    # a part reaches from REACH before it to REACH behind it; a span may be long, so it is put into every bin it touches
    left = rows.where(holds).withColumn("bin", F.explode(F.sequence(F.floor(F.col("s") / REACH), F.floor(F.col("e") / REACH) + 1)))
    right = rows.where(~holds).withColumn("bin", F.explode(F.sequence(F.floor(F.col("s") / REACH), F.floor(F.col("e") / REACH) + 1)))
    right = right.select("d", "rid", "p", "bin", *(F.col(c).alias(f"r{c}") for c in "sek"))
    near = (F.col("rs") - F.col("e") <= REACH) & (F.col("s") - F.col("re") <= REACH)
    pairs = left.join(right, ["d", "rid", "p", "bin"]).where(near)
    both = pairs.select("d", "rid", F.explode(F.array(F.struct("s", "e", "k"), F.struct(F.col("rs").alias("s"), F.col("re").alias("e"), F.col("rk").alias("k")))).alias("x"))
    return both.select("d", "rid", "x.s", "x.e", "x.k").where(F.col("k").isin("identifier", "secret", "endpoint")).distinct()


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row."""
    found = stored(find_parts(docs), "secrets")
    linked = link(found).groupBy("d", "rid").agg(F.collect_list(F.struct("s", "e", "k")).alias("linked"))
    rows = found.drop("parts").withColumn("d", F.coalesce("doc_id", F.lit(-1))).join(linked, ["d", "rid"], "left")
    order = F.array(*map(F.lit, KINDS))
    everything = F.concat("base", F.coalesce("linked", F.array().cast("array<struct<s:long,e:long,k:string>>")))
    ranked = F.array_sort(F.transform(everything, lambda x: F.struct(x["s"].alias("s"), F.array_position(order, x["k"]).alias("o"), x["e"].alias("e"), x["k"].alias("k"))))
    text = F.array_join(F.transform(ranked, lambda x: F.concat_ws(":", x["k"], x["s"], x["e"])), ",")
    n = lambda kind: F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", n("assign"), n("access"), n("hex"), "base_sha256", text.alias("spans"))
