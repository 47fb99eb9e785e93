"""Whitening of embeddings by a tiled covariance.

An entry c becomes the whole number floor(1024 * c) + 100000. Vectors are packed by row-blocks of a few thousand rows, each
cut into column blocks of TILE dimensions, which are shuffled by row-block; where a row-block arrives, each pair of its column
blocks, centred, is multiplied into the tile of that pair of dimensions. A task sums its row-blocks before it passes a tile
on, so that a tile comes once from each task, and tiles are summed by their key. The driver holds one square matrix of the
dimensions, whatever the number of rows; its eigenvectors, by falling eigenvalue, whiten the rows where they are read.

The fit list are the vectors of the most frequent length (the longer one on a tie) that are no null and hold no null, NaN or
infinite entry, nor one of 2^40 and more, which have no place in whole numbers here; other rows are dropped. Components end
where an eigenvalue is no more than 1e-12 of the largest: one vector, or many equal ones, have none, and thus no rows. Each
repeated row, and each without an id, is a row of its own. deviation is exact; it is null where it does not fit a long. An
empty table, or one without a usable vector, gives no rows. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm.common import small_batches
from loomgraph.plans.session import discard, stored

SCALE, SHIFT = 1024, 100_000
#: Dimensions on either side of a tile.
TILE = 32
#: Bytes of whole numbers in a row-block.
BLOCK_BYTES = 1 << 22
COMPONENTS = 8
#: Entries from here on are not used.
LARGEST = float(1 << 40)
#: Of the largest eigenvalue; components below have no variance to divide by.
LEAST_SHARE = 1e-12

_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _usable(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the batch, whole numbers by row and dimension) of its usable vectors, by their lengths."""
    column = batch.column(batch.schema.get_field_index("embedding"))
    lengths = np.diff(column.offsets.to_numpy())
    lengths[column.is_null().to_numpy(zero_copy_only=False)] = 0
    values = np.asarray(column.values.to_numpy(zero_copy_only=False), np.float64)  # null: NaN
    starts = column.offsets.to_numpy()[:-1]
    for d in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == d)
        found = values[starts[rows][:, None] + np.arange(d)]
        with np.errstate(invalid="ignore"):
            fine = (np.abs(found) < LARGEST).all(axis=1)
        if fine.any():
            yield rows[fine], np.floor(SCALE * found[fine]).astype(np.int64) + SHIFT


def _vectors(embeddings: DataFrame, *more: str) -> DataFrame:
    kind = dict(embeddings.dtypes)["embedding"]
    vector = F.col("embedding") if kind in ("array<float>", "array<double>") else F.col("embedding").cast("array<double>")
    return small_batches(embeddings.select(*(F.col(c).cast("long").alias(c) for c in more), vector.alias("embedding")))


def _length_and_sums(embeddings: DataFrame) -> tuple[int, int, list[int]]:
    """Length of the vectors of the fit list, their number, and the sum of each dimension, exact."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            for _, x in _usable(batch):
                n, s = totals.get(x.shape[1], (0, 0))
                # halves of the numbers are summed apart, so that no sum leaves 64 bits
                totals[x.shape[1]] = n + len(x), s + (x >> 20).sum(axis=0).astype(object) * (1 << 20) + (x & 0xFFFFF).sum(axis=0).astype(object)
        for d, (n, s) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([str(v) for v in s], pa.string())], ["length", "dim", "n", "total"])

    parts = _vectors(embeddings).mapInArrow(sums, "length int, dim int, n long, total string")
    by_dim = stored(parts.groupBy("length", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")), "sums")
    best = by_dim.where("dim = 0").orderBy(F.desc("n"), F.desc("length")).first()
    if best is None:
        discard(by_dim)
        return 0, 0, []
    rows = by_dim.where(F.col("length") == best["length"]).orderBy("dim").collect()
    discard(by_dim)
    return best["length"], best["n"], [int(r["total"]) for r in rows]


def _column_blocks(d: int, whole: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (row_block, col_block, width of a number, bytes) of row-blocks, relative to whole, in the smallest whole numbers."""
    rows = max(256, BLOCK_BYTES // (8 * d))

    def packed(x: np.ndarray, tag: int) -> pa.RecordBatch:
        cut = [x[:, i : i + TILE] for i in range(0, d, TILE)]
        cut = [c.astype(np.promote_types(np.min_scalar_type(c.min()), np.min_scalar_type(-abs(c.max()) - 1))) for c in cut]
        n = len(cut)
        return pa.RecordBatch.from_arrays([pa.array([tag] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([c.itemsize for c in cut], pa.int32()), pa.array([c.tobytes() for c in cut], pa.binary())], ["row_block", "col_block", "width", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tag, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for _, x in _usable(batch):
                if x.shape[1] == d:
                    held.append(x - whole)
                    n += len(x)
            if n >= rows:
                yield packed(np.concatenate(held), tag)
                tag, held, n = tag + 1, [], 0
        if n:
            yield packed(np.concatenate(held), tag)

    return run


def _tile_sums(d: int, rest: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of whole row-blocks in order, (tile, bytes): the products of all pairs of column blocks, centred, summed over the task."""
    n_blocks = -(-d // TILE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        now, cut = None, []

        def multiply() -> None:
            for i in range(len(cut)):
                for j in range(i, len(cut)):
                    sums[i * n_blocks + j] = sums.get(i * n_blocks + j, 0.0) + cut[i].T @ cut[j]

        for batch in batches:
            for row_block, i, width, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row_block != now:
                    multiply()
                    now, cut = row_block, []
                own = rest[i * TILE : (i + 1) * TILE]
                cut.append(np.frombuffer(block, f"i{width}").reshape(-1, len(own)) - own)
        multiply()
        yield _tiles(sums)

    return run


def _tiles(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["tile", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a tile, of rows of tiles in any order."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for tile, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sums[tile] = sums.get(tile, 0.0) + np.frombuffer(part)
    yield _tiles(sums)


def covariance(embeddings: DataFrame, d: int, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of the whole numbers, divisor n, by tiles."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])  # what the whole part of a mean leaves of it
    blocks = _vectors(embeddings).mapInArrow(_column_blocks(d, whole), "row_block long, col_block int, width int, block binary")
    dealt = blocks.repartition("row_block").sortWithinPartitions("row_block", "col_block")
    tiles = dealt.mapInArrow(_tile_sums(d, rest), "tile int, sums binary")
    total = tiles.repartition("tile").mapInArrow(_added, "tile int, sums binary")
    out, edges = np.zeros((d, d)), [*range(0, d, TILE), d]
    for tile, part in total.collect():  # one row a pair of column blocks
        i, j = divmod(tile, len(edges) - 1)
        t = np.frombuffer(part).reshape(edges[i + 1] - edges[i], -1) / n
        out[edges[i] : edges[i + 1], edges[j] : edges[j + 1]] = t
        out[edges[j] : edges[j + 1], edges[i] : edges[i + 1]] = t.T
    return out


def components(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling value and unit eigenvectors in columns, of those that have a variance to divide by."""
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    keep = values > LEAST_SHARE * max(values[0], 0.0)
    return values[keep], vectors[:, keep]


def _projected(d: int, n: int, sums: list[int], project: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """vec_id, deviation and the whitened entries of each row of the fit list."""
    whole = np.array([s // n for s in sums], np.int64)
    remainder = np.array([s % n for s in sums], np.int64)

    def deviations(y: np.ndarray) -> list[int | None]:
        """Sums of squares of n * y - remainder, in longs where all steps fit."""
        bound = n * int(np.abs(y).max(initial=0)) + n
        if bound * bound * d < 1 << 63:
            return ((n * y - remainder) ** 2).sum(axis=1).tolist()
        exact = ((n * y.astype(object) - remainder) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _usable(batch):
                if x.shape[1] == d:
                    y = x - whole
                    w = (y - remainder / n) @ project
                    ids = batch.column(batch.schema.get_field_index("vec_id")).take(pa.array(rows))
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(deviations(y), pa.int64()), lists], ["vec_id", "deviation", "w"])

    return run


def whiten(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error."""
    spark: SparkSession = embeddings.sparkSession
    d, n, sums = _length_and_sums(embeddings)
    values, vectors = components(v := covariance(embeddings, d, n, sums), most) if n else (np.zeros(0), v := np.zeros((0, 0)))
    if not len(values) or not values[0] > 0:
        return spark.createDataFrame([], _RESULT)
    rows = stored(_vectors(embeddings, "vec_id").mapInArrow(_projected(d, n, sums, vectors / np.sqrt(values)), "vec_id long, deviation long, w array<double>"), "whitened")
    pairs = [(i, j) for i in range(len(values)) for j in range(i, len(values))]
    errors = rows.agg(*(F.abs(F.covar_pop(F.col("w")[i], F.col("w")[j]) - float(i == j)).alias(f"e{i}_{j}") for i, j in pairs)).first()
    shares = F.array(*(F.lit(float(e / np.trace(v))) for e in values))
    each = rows.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", shares[F.col("at")].alias("explained"), F.lit(max(errors)).alias("identity_error")
    )
