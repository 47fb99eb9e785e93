"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

The rank file is a parameter; it is shipped to executors with the job, so that no path on them is assumed. Long texts
are cut where the split pattern always ends a piece, and the parts are encoded one after another; ids and bytes are
those of the whole text. A run of white space of any length is one piece, but for its last character if more text
follows; runs beyond LONG_RUN, on which the library's regex would exhaust its stack, are found by a scan and encoded as
that piece.

Nulls are empty texts. An empty text has no ids and decodes to no bytes. Repeated rows stay rows of their own. Other
columns of the table don't matter to encode(), and decode() keeps none but doc_id.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import doc_text, small_batches

RANKS = "byte_bpe_50k.tiktoken"
#: Characters of text given to the library at a time.
PART_CHARS = 1 << 18
#: White space characters in a row that are taken out of what the library's regex sees.
LONG_RUN = 1 << 14

#: A single space before a letter, after a character that is neither white space nor an apostrophe: the pattern has
#: only one white-space-led way on from here (" ?\p{L}+"), and nothing before it can reach over the space.
_SAFE = regex.compile(r"(?<=[^\s']) (?=\p{L})")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path(RANKS)


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.cache
def _white() -> np.ndarray:
    """Which of the code points up to the last white one are white space."""
    return np.array([regex.match(r"\p{White_Space}", chr(c)) is not None for c in range(0x3002)])


def _long_runs(text: str, least: int) -> Iterator[tuple[int, int]]:
    """Starts and ends of runs of at least so many white-space characters, in one pass."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    white = np.zeros(len(points) + 2, np.int8)
    white[1:-1] = _white()[np.minimum(points, 0x3001)]
    turns = np.flatnonzero(np.diff(white))
    starts, ends = turns[::2], turns[1::2]
    long = ends - starts >= least
    return zip(starts[long].tolist(), ends[long].tolist(), strict=True)


@functools.lru_cache(maxsize=2)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    """text in order, cut only at safe boundaries at about size characters; whole where there is none."""
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(encoding, text: str, size: int = PART_CHARS, run: int = LONG_RUN) -> np.ndarray:
    if len(text) <= min(size, run):
        return np.asarray(encoding.encode_ordinary(text), np.uint32)
    out, at = [], 0
    for start, stop in _long_runs(text, run):
        # a last space belongs to the word behind it, and any other last character is a piece of its own
        end = stop - (stop < len(text))
        out += [encoding.encode_ordinary(x) for x in parts(text[at:start], size)]
        out.append(encoding._encode_single_piece(text[start:end].encode()))
        at = end
    out += [encoding.encode_ordinary(x) for x in parts(text[at:], size)]
    return np.concatenate([np.asarray(x, np.uint32) for x in out])


def _shipped(docs: DataFrame, ranks: str | None, pattern: str | None):
    with open(ranks or default_ranks(), "rb") as f:
        return docs.sparkSession.sparkContext.broadcast((f.read(), pattern or default_pattern()))


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids array<int>."""
    shipped = _shipped(docs, ranks, pattern)

    def run(batches):
        encoding = _encoding(*shipped.value)
        for batch in batches:
            ids = [encode_text(encoding, t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)])
            flat = pa.array(np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["doc_id", "ids"])

    return doc_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, bytes binary of a table with doc_id and ids; null ids give no bytes."""
    shipped = _shipped(encoded, ranks, pattern)

    def run(batches):
        encoding = _encoding(*shipped.value)
        for batch in batches:
            raw = [encoding.decode_bytes(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    return small_batches(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids")).mapInArrow(run, "doc_id long, bytes binary")


def digests(docs: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, by encoding it and decoding the ids."""
    shipped = _shipped(docs, ranks, pattern)

    def run(batches):
        encoding = _encoding(*shipped.value)
        for batch in batches:
            counts, ids_hex, raw_hex = [], [], []
            for text in batch.column(1):
                ids = encode_text(encoding, text.as_py()).tolist()
                counts.append(len(ids))
                ids_hex.append(hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
                raw_hex.append(hashlib.sha256(encoding.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(raw_hex, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return doc_text(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
