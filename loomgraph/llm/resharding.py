"""Resharding by minimum-cost flow: new shards of nearly equal bytes, made from old ones by moving the fewest bytes.

The old shards supply bytes, the new ones have room for an equal share each, and a byte that stays where it is costs nothing
while one that moves costs one (or what a matrix says). The solver sees one number a shard, so its work depends on neither
rows nor bytes. Its transfers are cut from the running bytes of each old shard, which are kept by blocks of some thousand
rows: what stays is the front of a shard, and each transfer is the next run of blocks. Only a block on a cut is divided, by
rows. Running sums and slots are sums over blocks plus a count within one, so no task holds a shard.

Texts of over a fiftieth of a shard (fewer than 50 for each new shard) are placed one by one before, the largest first: at
home while that has room, else in the emptiest shard; the flow then fills what room is left up to one common level. So a
shard differs from that level by no more than the rounding of its cuts, one row or one group each, unless a single text is
larger. Groups of equal texts stay together where they lie in one block and have at most a hundredth of a shard; larger ones
are cut like other rows, and blocks crowded by copies are divided by row.

A null text has no bytes (size 16), a null or unknown old shard (outside 0 to new_shards-1) is left by all its rows. Repeated
rows are rows of their own. An empty table has no rows here. Other columns never matter to placements(), and rewrite() keeps
them all.
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import few
from loomgraph.plans.session import discard, stored

#: Bytes that a row counts for beside its text.
ROW_BYTES = 16
#: Rows in a block, about.
BLOCK_ROWS = 4096
#: Blocks of more than so many times BLOCK_ROWS are divided.
CROWDED = 4
#: A text is large if it has more than this part of a shard; a group is small if it has at most that.
LARGE, SMALL_GROUP = 50, 100
LAW = "bytes"
_BLOCK = ["old_shard", "block", "piece"]


def min_cost_flow(supply: list[int], room: list[int], cost: np.ndarray) -> dict[tuple[int, int], int]:
    """Amounts from i to j that place all supply within room at the least sum of amount * cost[i, j].

    Successive shortest ways in the graph of what is left, each filled to its bound. sum(room) >= sum(supply).
    """
    cost, left, free = np.asarray(cost, np.int64), np.array(supply, np.int64), np.array(room, np.int64)
    flow = np.zeros(cost.shape, np.int64)
    never = np.int64(1 << 60)
    while left.any():
        far, by = np.where(left > 0, 0, never), np.full(len(left), -1)
        near, came = np.full(len(free), never), np.full(len(free), -1)
        while True:
            out = far[:, None] + cost
            best = out.argmin(axis=0)
            shorter = (found := out[best, np.arange(len(free))]) < near
            near[shorter], came[shorter] = found[shorter], best[shorter]
            back = np.where(flow > 0, near - cost, never)
            best = back.argmin(axis=1)
            shorter = (found := back[np.arange(len(left)), best]) < far
            if not shorter.any():
                break
            far[shorter], by[shorter] = found[shorter], best[shorter]
        end = j = int(np.where(free > 0, near, never).argmin())
        way, amount = [], free[end]
        while True:
            i = int(came[j])
            way.append((i, j, 1))
            if by[i] < 0:
                break
            j = int(by[i])
            way.append((i, j, -1))
            amount = min(amount, flow[i, j])
        amount = min(amount, left[i])
        for a, b, sign in way:
            flow[a, b] += sign * amount
        left[i] -= amount
        free[end] -= amount
    return {(int(i), int(j)): int(flow[i, j]) for i, j in zip(*np.nonzero(flow), strict=True)}


def placed_large(large: list[tuple[int, int | None, int]], shards: int, share: int) -> tuple[dict[int, int], list[int]]:
    """Shards of large rows (uid, old shard, size), the largest first, and the bytes they take of each shard."""
    load, where = [0] * shards, {}
    emptiest = [(0, s) for s in range(shards)]
    for uid, home, size in sorted(large, key=lambda r: (-r[2], r[0])):
        if home is None or not 0 <= home < shards or load[home] + size > max(share, size):
            while emptiest[0][0] != load[emptiest[0][1]]:
                heapq.heappop(emptiest)
            home = emptiest[0][1]
        where[uid] = home
        load[home] += size
        heapq.heappush(emptiest, (load[home], home))
    return where, load


def rooms(load: list[int], total: int) -> list[int]:
    """Room beside load, total in all, that brings the emptiest shards to one level (give or take one)."""
    order = sorted(range(len(load)), key=lambda s: (load[s], s))
    used = 0
    for n in range(1, len(order) + 1):
        used += load[order[n - 1]]
        if n == len(order) or (total + used) <= n * load[order[n]]:
            break
    level, more = divmod(total + used, n)
    room = [0] * len(load)
    for at, s in enumerate(order[:n]):
        room[s] = level + (at < more) - load[s]
    return room


def _narrow(docs: DataFrame, old: Column, block: Column | None, *more: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    columns = [F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), old.cast("int").alias("old_shard")]
    return docs.select(F.monotonically_increasing_id().alias("uid"), *columns, *([block.cast("int").alias("block")] if block is not None else []), *more)


def _blocks(rows: DataFrame, n: int, given: bool) -> DataFrame:
    """rows with block and piece. Equal texts share a block, and a piece of it unless it is crowded."""
    if not given:
        rows = rows.withColumn("block", F.pmod(F.xxhash64("text_crc32"), F.lit(max(1, n // BLOCK_ROWS))).cast("int"))
    counts = stored(rows.groupBy("old_shard", "block").agg(F.count("*").alias("_n")).where(F.col("_n") > CROWDED * BLOCK_ROWS), "crowded")
    crowded = counts.select(F.col("old_shard").alias("_o"), F.col("block").alias("_b"), F.ceil(F.col("_n") / BLOCK_ROWS).alias("_pieces"))
    same = F.col("old_shard").eqNullSafe(F.col("_o")) & F.col("block").eqNullSafe(F.col("_b"))
    return rows.join(few(crowded), same, "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("uid"), F.col("_pieces")), F.lit(0)).cast("int")).drop("_o", "_b", "_pieces")


def placements(docs: DataFrame, old: Column, new_shards: int, cost: np.ndarray | None = None, block: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, old_shard, block, shard, slot and the columns to carry, a row for each of docs.

    old: a row's shard so far. cost: of a byte from each old shard, in rising order with null first, to each new one.
    block: a row's block within its old shard, if files go by it.
    """
    spark = docs.sparkSession
    narrow = stored(_narrow(docs, old, block, *carry), "rows")
    n, total = narrow.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = -(-total // new_shards)
    is_large = F.col("size") * LARGE > share
    large = [tuple(r) for r in narrow.where(is_large).select("uid", "old_shard", "size").collect()]  # fewer than LARGE a new shard
    where, load = placed_large(large, new_shards, share)
    rows = _blocks(narrow.where(~is_large), n, block is not None)
    sums = stored(rows.groupBy(*_BLOCK).agg(F.sum("size").alias("bytes")), "blocks")
    supply = [tuple(r) for r in sums.groupBy("old_shard").agg(F.sum("bytes")).orderBy(F.asc_nulls_first("old_shard")).collect()]
    moves = np.array([[int(o != s) for s in range(new_shards)] for o, _ in supply]).reshape(-1, new_shards) if cost is None else cost
    flow = min_cost_flow([b for _, b in supply], rooms(load, sum(b for _, b in supply)), moves)
    # where an old shard's running bytes go, what stays first
    cuts = []
    for i, (o, _) in enumerate(supply):
        at, row = 0, []
        for j in sorted((j for a, j in flow if a == i), key=lambda j: (j != o, j)):
            row.append((at := at + flow[i, j], j))
        cuts.append((o, row))
    cut = spark.createDataFrame(cuts, "_o int, cuts array<struct<upto:long, shard:int>>")  # one row an old shard
    first = Window.partitionBy("old_shard").orderBy("block", "piece").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    starts = stored(sums.withColumn("start", F.coalesce(F.sum("bytes").over(first), F.lit(0))), "starts")
    starts = starts.select(*(F.col(c).alias(f"_{c}") for c in _BLOCK), "start")
    met = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _BLOCK]
    within = Window.partitionBy(*_BLOCK).orderBy("text_crc32", "uid").rowsBetween(Window.unboundedPreceding, -1)
    alike = Window.partitionBy(*_BLOCK, "text_crc32")
    at = rows.withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0))).withColumns({"group": F.sum("size").over(alike), "group_at": F.min("at").over(alike)})
    small = F.col("group") * SMALL_GROUP <= share
    # twice the middle of what is placed as one
    middle = F.when(small, 2 * F.col("group_at") + F.col("group")).otherwise(2 * F.col("at") + F.col("size"))
    at = at.withColumn("middle", middle).join(few(starts), met[0] & met[1] & met[2], "left")
    at = at.join(F.broadcast(cut), F.col("old_shard").eqNullSafe(F.col("_o")), "left")
    to = F.get(F.filter("cuts", lambda c: 2 * c["upto"] > F.col("middle") + 2 * F.col("start")), F.lit(0))["shard"]
    kept = ["uid", "doc_id", "size", "text_crc32", *_BLOCK, *carry]
    small_rows = at.withColumn("shard", to).select(*kept, "shard")
    homes = F.broadcast(spark.createDataFrame(list(where.items()), "_uid long, shard int"))  # a row a large text
    own = F.col("block") if block is not None else F.lit(-1)
    large_rows = narrow.where(is_large).withColumns({"block": own, "piece": F.lit(-1)}).join(homes, F.col("uid") == F.col("_uid")).select(*kept, "shard")
    runs = Window.partitionBy(*_BLOCK, "shard").orderBy("text_crc32", "uid")
    numbered = stored(small_rows.unionByName(large_rows).withColumn("n", F.row_number().over(runs)), "placed")
    ends = numbered.groupBy("shard", *_BLOCK).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy(*_BLOCK).rowsBetween(Window.unboundedPreceding, -1)  # a row a run
    offsets = stored(ends.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))), "offsets")
    offsets = offsets.select(F.col("shard").alias("_shard"), *(F.col(c).alias(f"_{c}") for c in _BLOCK), "offset")
    out = numbered.join(few(offsets), met[0] & met[1] & met[2] & (F.col("shard") == F.col("_shard")))
    discard(narrow, sums)
    return out.select("doc_id", "size", "text_crc32", "old_shard", "block", "shard", (F.col("offset") + F.col("n") - 1).alias("slot"), *carry)


def reshard(docs: DataFrame, old: Column, new_shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    p = placements(docs, old, new_shards)
    return p.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Files of a shard, as write_shards() makes them.
SHARD_BLOCKS = 16


def _write(rows: DataFrame, root: str, number: int, kept: DataFrame | None = None) -> None:
    """Adds rows (row, shard, block) as folders of their own, then a manifest of these and those kept (v, shard, block).

    The manifest comes last, so that a reader sees all of a generation or nothing of it.
    """
    spark, v = rows.sparkSession, uuid.uuid4().hex
    # AQE splits what is too large for a file, and joins what is too small for a task
    rows.hint("rebalance", "shard", "block").withColumn("v", F.lit(v)).write.mode("append").partitionBy("v", "shard", "block").parquet(f"{root}/data")
    new = rows.select(F.lit(v).alias("v"), "shard", "block").distinct()
    manifest = new if kept is None else new.unionByName(kept)
    manifest.withColumn("number", F.lit(number)).write.partitionBy("number").mode("append").parquet(f"{root}/manifest")


def write_shards(docs: DataFrame, shard: Column, root: str, blocks: int = SHARD_BLOCKS) -> None:
    """docs as a table of shards in a new folder, each shard in blocks; a null shard is written as -1."""
    block = F.pmod(F.xxhash64(F.crc32(F.coalesce(F.col("text").cast("string"), F.lit("")))), F.lit(blocks))
    _write(docs.select(F.struct("*").alias("row"), F.coalesce(shard.cast("int"), F.lit(-1)).alias("shard"), block.cast("int").alias("block")), root, 0)


def _latest(spark: SparkSession, root: str) -> tuple[DataFrame, int]:
    manifest = spark.read.schema("v string, shard int, block int, number int").parquet(f"{root}/manifest")
    number = manifest.agg(F.max("number")).first()[0]
    return manifest.where(F.col("number") == number).select("v", "shard", "block"), number


def _folders(spark: SparkSession, root: str, folders: DataFrame) -> DataFrame:
    paths = [f"{root}/data/v={v}/shard={s}/block={b}" for v, s, b in folders.collect()]  # folders, not rows
    return spark.read.option("basePath", f"{root}/data").parquet(*paths)


def read_shards(spark: SparkSession, root: str) -> DataFrame:
    """row (the columns that were written), shard and block of all rows of the newest generation."""
    return _folders(spark, root, _latest(spark, root)[0]).select("row", "shard", "block")


def rewrite(spark: SparkSession, root: str, new_shards: int, cost: np.ndarray | None = None) -> DataFrame:
    """Reshards a table of write_shards() in place; returns what became of each folder: v, shard, block, rows, moved.

    Only folders with a row that moves are read whole and written anew; the others stay as they are, named by the new
    manifest. Files of earlier generations are left to whoever may still read them.
    """
    folders, number = _latest(spark, root)
    rows = _folders(spark, root, folders)
    place = {"_path": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index"), "_v": F.col("v")}
    narrow = rows.select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), "shard", "block", *(c.alias(n) for n, c in place.items()))
    placed = stored(placements(narrow, F.col("shard"), new_shards, cost, F.col("block"), tuple(place)), "placed")
    told = placed.groupBy(F.col("_v").alias("v"), F.col("old_shard").alias("shard"), "block").agg(F.count("*").alias("rows"), F.count_if(F.col("shard") != F.col("old_shard")).alias("moved"))
    told = stored(told, "folders")
    affected = told.where("moved > 0").select("v", "shard", "block")
    if not affected.isEmpty():
        whole = _folders(spark, root, affected).select("row", "block", *(c.alias(n) for n, c in place.items()))
        moved = whole.join(placed.select("_path", "_row", "shard"), ["_path", "_row"]).select("row", "shard", "block")
        _write(moved, root, number + 1, told.where("moved = 0").select("v", "shard", "block"))
    discard(placed)
    return told
