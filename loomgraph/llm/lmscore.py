"""Scores of texts under word counts and under the attention model.

Words are runs of non-white-space after A-Z are lower-cased; each text closes with one end, which counts as a token. The
base score is add-one smoothed from the counts of all training tokens; the model's is described in attention.py.

Training texts are those whose crc32(doc_id as text) mod 7 is not 2; a null id trains. Null texts are empty and score
their end. Repeated rows are counted and scored as often as they occur; other columns don't matter. Without training
texts, N and V are 0 and the model gives all ids the same chance.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import bpe, wordtable
from loomgraph.llm.attention import AttentionLM, Training, frame_type, text_ids
from loomgraph.llm.common import doc_text, small_batches
from loomgraph.plans.session import stored

END = b""
#: Ids scored at a time.
SCORE_IDS = 1 << 16


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def tokens(text: bytes) -> list[bytes]:
    return [*text.lower().split(), END]


def encoded(texts: DataFrame, shipped) -> DataFrame:
    """doc_id, ids (text_ids() of the whole lower-cased text, end included, in frame_type()), n_ids of each row.

    The ids say the lower-cased text byte for byte, so that it needn't be kept beside them.
    """

    def run(batches):
        library = bpe._encoding(*shipped.value)
        kind = frame_type(library.n_vocab + 1)
        for batch in batches:
            ids = [text_ids(library, library.n_vocab, [t.as_buffer().to_pybytes().lower()])[0].astype(kind) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())], ["doc_id", "ids", "n_ids"])

    return small_batches(texts).mapInArrow(run, "doc_id long, ids binary, n_ids long")


def subword_counts(training: DataFrame, n_ids: int) -> np.ndarray:
    """How often each of n_ids subword ids stands in the encoded training texts; at most a row for each id comes to the driver."""

    def run(batches):
        total = np.zeros(n_ids, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), frame_type(n_ids)), minlength=n_ids)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["id", "n"])

    got = training.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_ids)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


def score(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, how: Training = Training()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row; how: sizes of the training."""
    shipped = bpe._shipped(docs, ranks, pattern)
    texts = stored(encoded(doc_text(docs), shipped), "encoded")
    training = texts.where(~held_out())
    counts = stored(wordtable.count(doc_text(docs).where(~held_out()), tokens), "words")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"], total["v"]
    n_ids = bpe._encoding(*shipped.value).n_vocab + 1
    model = AttentionLM(subword_counts(training, n_ids)).learn(training, how)
    kind = frame_type(n_ids)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def lowered(column: pa.Array) -> list[bytes]:
        library = bpe._encoding(*shipped.value)
        return [library.decode_bytes(np.frombuffer(x.as_buffer(), kind)[:-1].tolist()) for x in column]

    def extras(column: pa.Array) -> list[list]:
        net, out = sent.value, []
        parts = [np.frombuffer(x.as_buffer(), kind) for x in column]
        i = 0
        while i < len(parts):
            j, size = i, 0
            while j < len(parts) and (j == i or size + len(parts[j]) <= SCORE_IDS):
                size += len(parts[j])
                j += 1
            lengths = np.array([len(x) for x in parts[i:j]], np.int64)
            out += (net.score(np.concatenate(parts[i:j]), lengths) / math.log(10)).tolist()
            i = j
        return [out]

    scored = wordtable.resolve(
        small_batches(texts.select("doc_id", "ids")),
        tokens,
        counts,
        "c",
        term=lambda c: math.log10(c + 1),
        term_sql=lambda c: F.log10(c + 1),
        missing=0.0,
        extra=(("score", "double"),),
        extras=extras,
        read=lowered,
    )
    base = F.col("total") - F.col("n_words") * F.lit(math.log10(n + v + 1))
    return small_batches(scored).select("doc_id", held_out().alias("held_out"), F.col("n_words").alias("n_tokens"), "n_known", F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
