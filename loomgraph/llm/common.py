"""Shared pieces: tables, Arrow text buffers, word bounds and 64-bit hashes in numpy.

A text column arrives in a task as one buffer of UTF-8 bytes with offsets. The helpers work on that buffer directly,
in slices of a few MB of text, so that a task's memory does not depend on how long the documents are (beyond the
longest single one).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch, and bytes of text that numpy takes at a time.
BATCH_ROWS = 2000
SLICE_BYTES = 1 << 21
#: Narrow rows in a task of steps whose size is known.
TASK_ROWS = 20_000
LEAST_TASKS = 8
#: Narrow rows (ids and hashes, some 100 bytes each in memory) that may be broadcast.
BROADCAST_ROWS = 500_000
#: The name under which a row's identity travels.
ROW = "row"

#: True for the bytes of [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_identity() -> Column:
    """A hash of a row's id and text. Beside the id it tells rows apart that share an id or have none."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def free_name(df: DataFrame, name: str) -> str:
    """A column name like name that df does not have."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while name in taken:
        name = f"_{name}"
    return name


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, a stored table of narrow rows, marked for broadcast if it has at most so many; else joins shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def without_rows(docs: DataFrame, name: str, rows: DataFrame, how: str = "left_anti") -> DataFrame:
    """docs, whose column name holds row_identity(), without the rows of a stored table (doc_id, row)."""
    ids = rows.select(F.col("doc_id").alias(f"{name}_id"), F.col(ROW).alias(f"{name}_row"))
    return docs.join(few(ids), (docs[name] == F.col(f"{name}_row")) & docs["doc_id"].cast("long").eqNullSafe(F.col(f"{name}_id")), how)


def with_rows(docs: DataFrame, name: str, rows: DataFrame) -> DataFrame:
    """docs with none but the rows of a stored table (doc_id, row)."""
    return without_rows(docs, name, rows, "left_semi")


def fitted(df: DataFrame, rows: int) -> DataFrame:
    """df in as many tasks as its rows ask for, at most as many as it has. rows: an upper bound on its number of rows."""
    return df.coalesce(max(LEAST_TASKS, -(-rows // TASK_ROWS)))


def gathered(df: DataFrame) -> DataFrame:
    """df, a join, in no more tasks than a shuffle makes: splits of large partitions are dealt evenly to them.

    Python's start is paid for once a task, and splits may be many more than the partitions.
    """
    return df.coalesce(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def small_batches(df: DataFrame) -> DataFrame:
    """df, after the session's bound on the rows in an Arrow batch was lowered, if it was higher; texts may be long.

    Plans are made when they run, so the bound holds for the session from then on: it can't end with this call.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def doc_text(docs: DataFrame, *more: str | Column) -> DataFrame:
    """doc_id (long), text (null: empty) and further columns; whatever else the table has stays behind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *more))


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and len+1 offsets into them, starting at 0."""
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of a text column, a few MB at a time."""
    data, offsets = buffer(column)
    for i, j in slices(offsets, limit):
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words in a buffer, and per document the index of its first word (n+1)."""
    inside = ~separators[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = offsets[:-1][np.diff(offsets) > 0]
    first[at] = inside[at]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    at = offsets[1:][np.diff(offsets) > 0] - 1
    last[at] = inside[at]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_ODD), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit of the input reaches every bit of the output."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << int(n - 1).bit_length()
        for key, base in (("up", _ODD), ("down", _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[key] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of each byte range, the same wherever the range stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(np.arange(1, 257, dtype=np.uint64))[data] * down[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * up[starts] + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, firsts: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words within a document, and per document the index of its first one (n+1).

    firsts has the index of each document's first word, as words() returns it. A document of fewer words has the one
    run of all its words; one without words has none.
    """
    n = len(hashes)
    lengths = np.diff(firsts)
    counts = np.where(lengths >= width, lengths - width + 1, np.minimum(lengths, 1))
    at = np.zeros(len(firsts), np.int64)
    np.cumsum(counts, out=at[1:])
    start = np.repeat(firsts[:-1] - at[:-1], counts) + np.arange(at[-1])
    room = np.minimum(np.repeat(lengths, counts), width)
    out = np.zeros(len(start), np.uint64)
    for k in range(width):
        word = hashes[np.minimum(start + k, n - 1)] if n else hashes
        out = np.where(room > k, mix(out * np.uint64(0xD1342543DE82EF95) + word), out)
    return out, at


def row_hash(texts: list[bytes]) -> list[int]:
    """A signed 64-bit hash of each text, to tell rows with one id apart."""
    import xxhash

    return [xxhash.xxh3_64_intdigest(t) - (1 << 63) for t in texts]
