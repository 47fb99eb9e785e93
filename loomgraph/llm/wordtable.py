"""Counts of the words of a corpus, and joins of per-document word counts with a value per word.

count() makes one row per distinct word. resolve() joins every document's distinct words with such a table. The most
frequent words (at most HEAD_WORDS, each in at most HEAD_BYTES bytes as a longer one is known by its digest, so a few MB
whatever the corpus) go to every task as a dictionary and are summed while a document is read; all other words are shuffled
and joined. Only rarer words are shuffled that way, however long they are, and AQE splits what is still uneven.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import row_hash

#: Distinct words that a task holds before it hands its counts on.
FLUSH_WORDS = 200_000
HEAD_WORDS = 1 << 17
HEAD_BYTES = 64
#: Rows of (document, word) that a task hands on at a time.
OUT_ROWS = 50_000


def count(texts: DataFrame, split: Callable[[bytes], list[bytes]]) -> DataFrame:
    """word binary, c long over all texts of a table (doc_id, text)."""

    def batch_of(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

    def run(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(1):
                seen.update(split(text.as_buffer().to_pybytes()))
                if len(seen) >= FLUSH_WORDS:
                    yield batch_of(seen)
                    seen = Counter()
        if seen:
            yield batch_of(seen)

    return texts.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def short_key(word: bytes) -> bytes:
    """The word, or for a long one its digest behind a space, which no word holds."""
    return word if len(word) <= HEAD_BYTES else b" " + hashlib.sha256(word).digest()


def head(counts: DataFrame, value: str) -> dict[bytes, float]:
    """value of the most frequent words, by short_key()."""
    key = F.when(F.length("word") <= HEAD_BYTES, F.col("word")).otherwise(F.concat(F.lit(b" "), F.unhex(F.sha2("word", 256))))
    got = counts.select(key.alias("key"), "c", value if value != "c" else F.col("c").alias("_v")).orderBy(F.desc("c"), "key").limit(HEAD_WORDS).toArrow().drop(["c"])
    return dict(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))


def _bytes(column: pa.Array) -> list[bytes]:
    return [t.as_buffer().to_pybytes() for t in column]


def resolve(
    texts: DataFrame,
    split: Callable[[bytes], list[bytes]],
    counts: DataFrame,
    value: str,
    term: Callable[[float], float],
    term_sql: Callable[[Column], Column],
    missing: float,
    extra: tuple[tuple[str, str], ...] = (),
    extras: Callable[..., list[list]] | None = None,
    read: Callable[[pa.Array], list[bytes]] = _bytes,
) -> DataFrame:
    """Per row of texts: doc_id, n_words, n_known, total, and the extra columns (doubles or longs by their types).

    total is the sum over the words of term(value of the word), or of missing for words that the table lacks. extras
    gives further columns from a list of texts; with a read, which makes texts of another second column, from that. term and term_sql say the same in Python and in SQL.
    """
    dictionary = texts.sparkSession.sparkContext.broadcast({w: term(v) for w, v in head(counts, value).items()})
    names = ["word", "doc_id", "rid", "n", "words", "known", "total", *(x for x, _ in extra)]
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
    kinds += [pa.float64() if t == "double" else pa.int64() for _, t in extra]

    def run(batches):
        known = dictionary.value
        for batch in batches:
            ids, raw = batch.column(0).to_pylist(), read(batch.column(1))
            more = extras(batch.column(1) if read is not _bytes else raw) if extras else []
            rids = row_hash(raw)
            out: list[list] = [[] for _ in range(4)]
            sums: list[list] = [[] for _ in range(3)]
            for doc_id, rid, text in zip(ids, rids, raw, strict=True):
                here = Counter(split(text))
                found = list(map(known.get, here))
                if max(map(len, here), default=0) > HEAD_BYTES:
                    found = [known.get(short_key(w)) if v is None else v for w, v in zip(here, found, strict=True)]
                total = math.fsum([n * v for n, v in zip(here.values(), found, strict=True) if v is not None])
                rest = {w: n for (w, n), v in zip(here.items(), found, strict=True) if v is None}
                n_words = sum(here.values())
                for x, v in zip(sums, (n_words, n_words - sum(rest.values()), total), strict=True):
                    x.append(v)
                out[0] += rest
                out[1] += [doc_id] * len(rest)
                out[2] += [rid] * len(rest)
                out[3] += rest.values()
                if len(out[0]) >= OUT_ROWS:
                    yield pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(out, kinds, strict=False)), *(pa.nulls(len(out[0]), k) for k in kinds[4:])], names)
                    out = [[] for _ in range(4)]
            if out[0]:
                yield pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip(out, kinds, strict=False)), *(pa.nulls(len(out[0]), k) for k in kinds[4:])], names)
            # one row for the document itself, under a key that no word has (words hold no space)
            keys = [b" %d" % r for r in rids]
            columns = [keys, ids, rids, None, *sums, *more]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(ids), k) if x is None else pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

    schema = "word binary, doc_id long, rid long, n long, words long, known long, total double" + "".join(f", {x} {t}" for x, t in extra)
    rows = texts.mapInArrow(run, schema)
    joined = rows.join(counts.select("word", F.col(value).alias("_v")), "word", "left")
    found = F.col("n").isNotNull() & F.col("_v").isNotNull()
    rest = F.when(found, F.col("n") * term_sql(F.col("_v"))).when(F.col("n").isNotNull(), F.col("n") * F.lit(float(missing)))
    summed = joined.groupBy("doc_id", "rid").agg(
        F.count("words").alias("_copies"),
        F.sum("words").alias("n_words"),
        (F.coalesce(F.sum("known"), F.lit(0)) + F.coalesce(F.sum(F.when(found, F.col("n"))), F.lit(0))).alias("n_known"),
        (F.coalesce(F.sum("total"), F.lit(0.0)) + F.coalesce(F.sum(rest), F.lit(0.0))).alias("total"),
        *(F.max(x).alias(x) for x, _ in extra),
    )
    # rows that repeat in full were summed together; each gets its share back
    return summed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select(
        "doc_id",
        (F.col("n_words") / F.col("_copies")).cast("long").alias("n_words"),
        (F.col("n_known") / F.col("_copies")).cast("long").alias("n_known"),
        (F.col("total") / F.col("_copies")).alias("total"),
        *(x for x, _ in extra),
    )
