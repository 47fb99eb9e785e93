"""Near-duplicate classes by DartMinHash signatures and banded joining.

A document is the multiset of its five-word shingles (white-space words, A-Z in lower case); the similarity of two is
the weighted Jaccard similarity of those, by counts. Every occurrence of a shingle is a unit region of weight. Hashed darts
fall on each region at unit rate over a rank axis; a dart belongs to one of the signature's COORDINATES, and the dart of
lowest rank in a coordinate is kept. Two documents agree in a coordinate with the probability of their similarity.

Documents with the same words are one text from the start. Texts that agree in a band of ROWS coordinates meet in a
bucket. A bucket's members are compared with one leader, then (only while the bucket still holds members of different
classes) with 64, 4096, ... further leaders, drawn by hash; a leader leaves its bucket once it has met all others. So every
pair of a bucket is either compared or already in one class, and no bucket is expanded into its pairs. A bucket that holds
more than CROWDED members of different classes after its first leader is replaced by prefix buckets: the regions of each of its members
stand from rare to frequent among all such members, and two texts of the asked similarity share a region among so many of
the first that the rest couldn't hold all they must have in common (prefixes()). No pair of a crowded bucket is lost by
that, and texts that have one passage in common aren't all compared, as its regions stand last. A pair ends in the join where its sizes rule the
asked similarity out, where its parity sketches differ in too many bits, or where its signatures agree in fewer than PRUNE
of the coordinates (chance 2e-5 for a pair of just that similarity); all others are verified on the shingles of their
whole texts. A parity sketch has, for each of its bits, whether an odd number of regions
falls there, so two sketches never differ in more bits than there are regions in just one of the texts. That bound is exact
below 1024 shingles; of longer texts every second, fourth, ... region is sketched, and the bound gets DEVIATIONS standard
deviations of room (chance below 1e-5).

Nulls are empty texts; texts without words are one class; a text of fewer than five words has one shingle of all its words.
Repeated rows fall into one class. Null ids are a value that sorts first and is null in the result. Other columns don't
matter. A row is known by its id and its text together, so that rows that share an id, or have none, stay apart.
"""

from __future__ import annotations

import bisect
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import ROW, doc_text, few, fitted, free_name, gathered, mix, row_identity, shingles, small_batches, text_slices, with_rows, without_rows, word_hashes, words
from loomgraph.llm.graph import components
from loomgraph.plans.session import discard, freed, keep, scratch, stored

WIDTH = 5
SIMILARITY = 0.8
COORDINATES = 80
ROWS = 4
PRUNE = 0.6
#: Four bits of each coordinate, packed into longs: enough to count how many agree.
PACKED = COORDINATES // 16
#: Bits of a parity sketch, packed into longs, and the room left where regions are sampled.
PARITY = 1024
DEVIATIONS = 4.5
#: Leaders in a bucket grow by this factor a round.
GROWTH = 64
#: Members of a bucket, after its first leader, beyond which prefix buckets take its place.
CROWDED = 4096
#: The most frequent regions of crowded members, which stand last; any order of regions finds the same pairs.
HEAD_REGIONS = 1 << 17
#: Least sizes of the size classes, each an eighth above the one before.
SIZES = [1]
while SIZES[-1] < 1 << 40:
    SIZES.append(SIZES[-1] + max(1, SIZES[-1] // 8))
#: Members (or leaders) of a bucket that are compared at a time, on average; and pairs that numpy takes at a time.
CHUNK = 128
PIECE = 100_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
EMPTY = np.uint64(2**64 - 1)
_POISSON = np.cumsum([math.exp(-1) / math.factorial(j) for j in range(18)])


def units(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, region hash) of every unit of weight: the c-th occurrence of a shingle is a region of its own."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.argsort(mix(hashes ^ mix(doc.astype(np.uint64) + np.uint64(1))), kind="stable")
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    c = np.arange(len(h)) - np.repeat(first, np.diff(np.concatenate([first, [len(h)]])))
    return d, mix(h + c.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def throw(regions: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Darts on regions with ranks in [level, level+1): the region's index, and the dart's hash. Poisson of mean one."""
    v = mix(regions + mix(level.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)))
    n = np.searchsorted(_POISSON, (v >> np.uint64(11)).astype(np.float64) * 2.0**-53, "right")
    who = np.repeat(np.arange(len(regions)), n)
    k = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
    return who, mix(v[who] + (k + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def signatures(hashes: np.ndarray, at: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """(documents, k): per coordinate the earliest dart, as its rank in the upper bits and its hash in the lower."""
    return earliest(*units(hashes, at), len(at) - 1, k)


def earliest(doc: np.ndarray, region: np.ndarray, n: int, k: int = COORDINATES) -> np.ndarray:
    """The signatures of n documents, from their regions."""
    out = np.full(n * k, EMPTY, np.uint64)
    low, high = 0, 1
    while len(region):
        for part in range(low, high, max(1, 200_000 // len(region))):  # ranks from low to high, in bounded pieces
            levels = np.arange(part, min(high, part + max(1, 200_000 // len(region))))
            who, dart = throw(np.tile(region, len(levels)), np.repeat(levels, len(region)))
            level = levels[who // len(region)]
            rank = (level.astype(np.uint64) << np.uint64(28)) | (mix(dart + np.uint64(1)) >> np.uint64(36))
            place = doc[who % len(region)] * k + ((dart >> np.uint64(32)) % np.uint64(k)).astype(np.int64)
            np.minimum.at(out, place, (rank << np.uint64(24)) | (dart & np.uint64(0xFFFFFF)))
        # documents with an empty coordinate go on to higher ranks
        short = (out.reshape(n, k) == EMPTY).any(1)
        stay = short[doc]
        doc, region = doc[stay], region[stay]
        low, high = high, high * 2
    return out.reshape(n, k)


def bands(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    n, k = signature.shape
    out = np.broadcast_to(mix(np.arange(k // rows, dtype=np.uint64) + np.uint64(77)), (n, k // rows)).copy()
    for r in range(rows):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + signature[:, r::rows][:, : k // rows])
    return out.view(np.int64)


def _lower_shingles(data: np.ndarray, offsets: np.ndarray):
    starts, ends, firsts = words(data, offsets)
    return shingles(word_hashes(LOWER[data], starts, ends), firsts, WIDTH)


def text_key(raw: bytes) -> bytes:
    return hashlib.md5(b" ".join(raw.lower().split())).digest()


def packed(signature: np.ndarray) -> np.ndarray:
    """(documents, COORDINATES / 16): the low four bits of a hash of each coordinate, sixteen to a long."""
    bits = (mix(signature) & np.uint64(15)).reshape(len(signature), -1, 16)
    return (bits << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(2, dtype=np.uint64).view(np.int64)


def levels_of(weights: np.ndarray) -> np.ndarray:
    """How often the regions of a document are halved for its parity sketch: 0 below 1024, 1 below 2048, and so on."""
    return np.maximum(0, np.frexp(weights.astype(np.float64))[1] - 10)


def parities(doc: np.ndarray, region: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """(documents, PARITY / 64): the parity of the sampled regions that fall on each bit."""
    r = mix(region + np.uint64(0xA0761D6478BD642F))
    every = (np.uint64(1) << levels.astype(np.uint64)) - np.uint64(1)
    taken = (r >> np.uint64(10)) & every[doc] == 0
    n = np.bincount(doc[taken] * PARITY + (r[taken] % np.uint64(PARITY)).astype(np.int64), minlength=len(levels) * PARITY)
    return np.packbits((n & 1).astype(np.uint8)).view(np.int64).reshape(len(levels), -1)


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, row (its identity beside the id), key (of its words), bands array, print of each row.

    A print is longs: weight (shingles), level, packed signature and parity sketch, all that a pair is pruned by.
    """

    def run(batches):
        for batch in batches:
            keys, rows, prints = [], [], []
            for i, j, data, offsets in text_slices(batch.column(1)):
                raw = data.tobytes()
                keys += [text_key(raw[offsets[k] : offsets[k + 1]]) for k in range(j - i)]
                hashes, at = _lower_shingles(data, offsets)
                doc, region = units(hashes, at)
                signature = earliest(doc, region, j - i)
                n, banded = np.diff(at), bands(signature)
                levels = levels_of(n)
                rows += [x if m else [] for x, m in zip(banded, n.tolist(), strict=True)]
                prints += [x.tobytes() for x in np.concatenate([n[:, None], levels[:, None], packed(signature), parities(doc, region, levels)], axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(rows, pa.list_(pa.int64())), pa.array(prints, pa.binary())], ["doc_id", ROW, "key", "bands", "print"])

    return doc_text(docs, row_identity().alias(ROW)).mapInArrow(run, f"doc_id long, {ROW} long, key binary, bands array<long>, print binary")


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The share of coordinates in which packed signatures agree, estimated without those that agree by chance."""
    d = (x ^ y).view(np.uint64)
    d |= d >> np.uint64(1)
    d |= d >> np.uint64(2)
    differ = np.bitwise_count(d & np.uint64(0x1111111111111111)).sum(1, dtype=np.int64)
    return ((1 - differ / COORDINATES) - 1 / 16) * (16 / 15)


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether the parity sketches of prints allow the asked similarity; those of different levels always do."""
    odd = slice(2 + PACKED, 2 + PACKED + PARITY // 64)
    differ = np.bitwise_count((x[:, odd] ^ y[:, odd]).view(np.uint64)).sum(1, dtype=np.int64)
    most = (x[:, 0] + y[:, 0]) * ((1 - SIMILARITY) / (1 + SIMILARITY)) / 2.0 ** x[:, 1]
    room = np.where(x[:, 1] > 0, DEVIATIONS * np.sqrt(most), 1e-6)
    return (x[:, 1] != y[:, 1]) | (differ <= most + room)


def chunks(members: DataFrame, sketches: DataFrame, name: str) -> DataFrame:
    """bucket, name: the members of a bucket with their classes and prints, in arrays of about CHUNK."""
    # only buckets of more than a chunk need their sizes, which are met without dealing out the members by bucket
    large = stored(members.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK), "large")
    part = F.pmod(F.xxhash64("key", F.lit(CHUNK)), F.coalesce(F.ceil(F.col("n") / CHUNK), F.lit(1))).alias("part")
    dealt = members.join(few(large), "bucket", "left").select("bucket", part, "key", "class").join(sketches.select("key", "print"), "key")
    return dealt.groupBy("bucket", "part").agg(F.collect_list(F.struct("key", "class", "print")).alias(name)).drop("part")


def _unpacked(column: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Offsets of a column of chunks; and of all their entries the keys, the classes, the classes as longs, the prints."""
    entries, at = column.flatten(), column.offsets.to_numpy()
    key, group, prints = (entries.field(i) for i in range(3))
    longs = lambda x: np.frombuffer(b"".join(x.to_pylist()), np.int64).reshape(len(x), -1)
    return at - at[0], key, group, longs(group), longs(prints)


def possible_pairs(members: DataFrame, leaders: DataFrame, sketches: DataFrame) -> DataFrame:
    """x, y, kx, ky: keys and classes of a member and a leader of its bucket that may have the asked similarity.

    Chunks of members meet chunks of leaders, so a large bucket is dealt over many rows of bounded size.
    """
    met = chunks(members, sketches, "members").join(chunks(leaders, sketches, "leaders"), "bucket")

    def run(batches):
        for batch in batches:
            (at, key, group, g, p), (lat, lkey, lgroup, lg, lp) = _unpacked(batch.column(0)), _unpacked(batch.column(1))
            each = np.diff(lat)
            ends = np.cumsum(np.diff(at) * each)
            for lo in range(0, int(ends[-1]) if len(ends) else 0, PIECE):
                n = np.arange(lo, min(lo + PIECE, int(ends[-1])))
                row = np.searchsorted(ends, n, "right")
                n -= np.where(row > 0, ends[row - 1], 0)
                i, j = at[row] + n // each[row], lat[row] + n % each[row]
                for holds in (
                    lambda: (g[i] != lg[j]).any(1),
                    lambda: np.minimum(p[i, 0], lp[j, 0]) >= SIMILARITY * np.maximum(p[i, 0], lp[j, 0]),
                    lambda: agreement(p[i, 2 : 2 + PACKED], lp[j, 2 : 2 + PACKED]) >= PRUNE,
                    lambda: alike(p[i], lp[j]),
                ):
                    stay = np.flatnonzero(holds())
                    i, j, row = i[stay], j[stay], row[stay]
                yield pa.RecordBatch.from_arrays([key.take(pa.array(i)), lkey.take(pa.array(j)), group.take(pa.array(i)), lgroup.take(pa.array(j))], ["x", "y", "kx", "ky"])

    return small_batches(gathered(met.select("members", "leaders"))).mapInArrow(run, "x binary, y binary, kx binary, ky binary")


def cells(docs: DataFrame, owners: DataFrame) -> DataFrame:
    """key, cells: the sorted region hashes (8 bytes each) of one whole text for each key of owners (key, owner).

    owner is the row (doc_id and identity) that stands for a key. The text table is read once. While the owners are few
    (BROADCAST_ROWS) they go to the texts, so that only the hashes of texts in question move; beyond that texts are
    shuffled by row. Two documents' similarity is the Jaccard similarity of their sets of regions.
    """

    def run(batches):
        for batch in batches:
            keys, out = [], []
            for want, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes()
                if text_key(raw) == want:
                    data = np.frombuffer(raw, np.uint8)
                    keys.append(want)
                    out.append(np.sort(units(*_lower_shingles(data, np.array([0, len(data)])))[1]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.binary())], ["key", "cells"])

    texts = doc_text(docs, row_identity().alias(ROW))
    owners = owners.select("key", F.col("owner.doc_id").alias("_id"), F.col(f"owner.{ROW}").alias("_row"))
    met = texts.join(few(owners), (F.col(ROW) == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("key", "text")
    return small_batches(met).mapInArrow(run, "key binary, cells binary").dropDuplicates(["key"])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct region hashes: the weighted one of their documents."""
    both = np.sort(np.concatenate([a, b]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared / max(1, len(both) - shared)


def verified(pairs: DataFrame, library: DataFrame) -> DataFrame:
    """The pairs (a, b and their classes ka, kb) with linked: whether they have the asked similarity. library: key, cells."""
    side = lambda c: library.select(F.col("key").alias(c), F.col("cells").alias(f"c{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("ca", "cb", *pairs.columns)

    def run(batches):
        for batch in batches:
            linked = [similarity(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) >= SIMILARITY for x, y in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(linked, pa.bool_())], [*batch.schema.names[2:], "linked"])

    return small_batches(gathered(met)).mapInArrow(run, ", ".join(f"{c} binary" for c in pairs.columns) + ", linked boolean")


def least_shared(m: int, n: int) -> int:
    """How many regions texts of m and n regions share at least, if they have the asked similarity."""
    return math.ceil(SIMILARITY / (1 + SIMILARITY) * (m + n) * (1 - 1e-12))


def prefix_buckets(regions: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The prefix buckets of a text: two texts of the asked similarity have one in common.

    seen: how often each region occurs. With an order of all regions, and least_shared() a lower bound of what two texts
    have in common, the first region in common is followed by all others; so it is among the first n - least + 1 of both.
    Each pair of size classes has its own buckets, as the bound follows from the partner's least size.
    """
    n, order = len(regions), regions[np.lexsort((regions, seen))]
    if not n:
        return np.zeros(0, np.int64)
    least, most = math.ceil(SIMILARITY * n * (1 - 1e-12)), math.floor(n / SIMILARITY * (1 + 1e-12))
    own, low, high = (bisect.bisect_right(SIZES, x) - 1 for x in (n, least, most))
    out = [np.zeros(0, np.uint64)]
    for other in range(low, high + 1):
        room = n - least_shared(n, max(least, SIZES[other])) + 1
        out.append(mix(order[: max(0, room)] ^ mix(np.array([min(own, other) << 16 | max(own, other)], np.uint64))))
    return np.concatenate(out).view(np.int64)


def prefixes(library: DataFrame) -> DataFrame:
    """key, bucket: all prefix buckets of each key of a stored table (key, cells)."""

    def counted(batches):
        for batch in batches:
            region, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(region), pa.array(n)], ["region", "n"])

    seen = small_batches(library.select("cells")).mapInArrow(counted, "region long, n long").groupBy("region").agg(F.sum("n").alias("n"))
    with freed(library.sparkSession):
        head = seen.where(F.col("n") > 1).orderBy(F.desc("n"), "region").limit(HEAD_REGIONS).toArrow().sort_by("region")
    sent = library.sparkSession.sparkContext.broadcast((head["region"].to_numpy(), head["n"].to_numpy()))

    def run(batches):
        known, often = sent.value
        for batch in batches:
            keys, buckets = [], []
            for i, (key, cells) in enumerate(zip(batch.column(0), batch.column(1), strict=True), 1):
                region = np.frombuffer(cells.as_buffer(), np.int64)
                at = np.minimum(np.searchsorted(known, region), max(0, len(known) - 1))
                seen = np.where(known[at] == region, often[at], 0) if len(known) else np.zeros(len(region), np.int64)
                buckets.append(np.unique(prefix_buckets(region.view(np.uint64), seen)))
                keys.append(key.as_py())
                if i == len(batch) or sum(map(len, buckets)) >= PIECE:
                    of = np.repeat(np.arange(len(keys)), [len(x) for x in buckets])
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).take(pa.array(of)), pa.array(np.concatenate(buckets))], ["key", "bucket"])
                    keys, buckets = [], []

    return small_batches(library.select("key", "cells")).mapInArrow(run, "key binary, bucket long")


def divided(members: DataFrame, most: int, library: DataFrame | None = None) -> DataFrame:
    """Members with the buckets of more than most of them divided.

    With a library (key, cells), a key's crowded buckets give way to its prefix buckets, in which every pair of the asked
    similarity meets. Without one they meet two by two in new ones, so that two keys need two crowded buckets in common, or
    an uncrowded one; that is for callers who may lose the others.
    """
    sized = members.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > most).select("bucket")
    crowded = stored(sized, "crowded")
    if crowded.isEmpty():
        return members
    own = members.join(crowded, "bucket").groupBy("key").agg(F.first("age").alias("age"), F.first("class").alias("class"), F.sort_array(F.collect_set("bucket")).alias("b"))
    if library is None:
        two = F.transform("b", lambda x, i: F.transform(F.slice("b", i + 2, F.size("b")), lambda y: F.xxhash64(x, y)))
        new = own.select(F.explode(F.flatten(two)).alias("bucket"), "key", "age", "class")
    else:
        own = stored(own.drop("b"), "crowd")
        found = stored(prefixes(library.join(few(own.select("key")), "key", "left_semi")), "prefixes")
        new = found.join(few(own), "key").select("bucket", "key", "age", "class")
    met = new.groupBy("bucket").agg(F.min("class").alias("c1"), F.max("class").alias("c2")).where(F.col("c1") != F.col("c2")).select("bucket")
    return members.join(crowded, "bucket", "left_anti").unionByName(new.join(met, "bucket"))


def linked_classes(docs: DataFrame, texts: DataFrame, crowded_from: int | None = CROWDED) -> DataFrame:
    """node, component (its smallest key) of every key that has a link. texts: one row per key."""
    members = texts.select("key", F.col("owner.doc_id").alias("age"), F.explode("bands").alias("bucket"))
    crowded = members.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("bucket")
    members = stored(members.join(crowded, "bucket"), "buckets").withColumn("class", F.col("key"))
    met = members.select("key").distinct()
    sketches = stored(texts.join(met, "key", "left_semi").select("key", "owner", "print"), "met")
    library = stored(cells(docs, sketches.select("key", "owner")), "library")
    classes, leaders_each = None, 1
    while n := members.count():
        with scratch():
            # a round's leaders: the oldest document first, as copies tend to be younger; then by hash
            rank = F.struct("age", "key") if leaders_each == 1 else F.struct(F.xxhash64("key"), "key")
            salt = F.pmod(F.xxhash64("key", F.lit(leaders_each)), F.lit(leaders_each))
            first = F.min_by(F.struct("key", "class"), rank).alias("x")
            leaders = members.withColumn("salt", salt).groupBy("bucket", "salt").agg(first).select("bucket", "x.key", "x.class")
            leaders = stored(fitted(leaders, n), "leaders")
            least = F.col("x") < F.col("y")
            sides = [F.when(least, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("x", "y", "a"), ("y", "x", "b"), ("kx", "ky", "ka"), ("ky", "kx", "kb"))]
            pairs = possible_pairs(members, leaders, sketches).select(*sides).distinct()
            new = stored(verified(pairs, library), "tested").where("linked")
            # leaders have met everyone; the others stay while their bucket holds more than one class
            rest = members.join(leaders.select("bucket", "key"), ["bucket", "key"], "left_anti")
            if not new.isEmpty():
                merged = stored(components(new.select(F.col("ka").alias("a"), F.col("kb").alias("b"))), "merged")
                classes = stored(renamed(classes, merged), "classes") if classes is not None else merged
                rest = rest.join(merged.withColumnRenamed("node", "class"), "class", "left")
                rest = rest.select("bucket", "key", "age", F.coalesce("component", "class").alias("class"))
            rest = stored(fitted(rest, n), "rest")
            mixed = rest.groupBy("bucket").agg(F.min("class").alias("c1"), F.max("class").alias("c2")).where(F.col("c1") != F.col("c2")).select("bucket")
            members = stored(fitted(rest.join(mixed, "bucket"), n), "mixed")
            if leaders_each == 1 and crowded_from is not None:
                members = stored(divided(members, crowded_from, library), "divided")
            keep(members)
            if classes is not None:
                keep(classes)
        leaders_each *= GROWTH
    discard(library, sketches)
    return classes if classes is not None else texts.select(F.col("key").alias("node"), F.col("key").alias("component")).limit(0)


def renamed(classes: DataFrame, merged: DataFrame) -> DataFrame:
    """node, component after classes have merged; merged: node (a class, by its smallest key), component."""
    now = merged.select(F.col("node").alias("component"), F.col("component").alias("into"))
    old = classes.join(now, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    return old.union(merged.join(classes, "node", "left_anti").select("node", "component"))


def membership(docs: DataFrame, crowded_from: int | None = CROWDED) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, row, key, ...), and per key its class's keeper (the least doc_id and row) and class_size."""
    with scratch():
        rows = keep(stored(sketch(docs), "sketches"))
        # a struct with a null id is less than any other, so that it stands for its text
        grouped = rows.groupBy("key").agg(F.first("bands").alias("bands"), F.first("print").alias("print"), F.min(F.struct("doc_id", ROW)).alias("owner"), F.count("*").alias("n"))
        texts = stored(grouped, "texts")
        classes = linked_classes(docs, texts, crowded_from)
        named = texts.select("key", "owner", "n").join(classes.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        sized = named.groupBy("component").agg(F.min("owner").alias("keeper"), F.sum("n").alias("class_size"))
        return rows, keep(stored(named.select("key", "component").join(sized, "component").select("key", "keeper", "class_size"), "membership"))


def classify(docs: DataFrame, crowded_from: int | None = CROWDED) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), class_size of each row.

    crowded_from: members beyond which prefix buckets take a bucket's place, which loses no pair; None: none is replaced.
    """
    rows, by_key = membership(docs, crowded_from)
    return rows.select("doc_id", "key").join(by_key, "key").select("doc_id", F.col("keeper.doc_id").alias("class_id"), "class_size")


def deduplicate(docs: DataFrame, crowded_from: int | None = CROWDED) -> DataFrame:
    """The table with one row of each class, one with the smallest doc_id; all columns stay.

    The rows that go are taken out, which are few against the table. Of rows that repeat with id and text, any one stays.
    crowded_from is as in classify().
    """
    rows, by_key = membership(docs, crowded_from)
    placed = rows.select("doc_id", ROW, "key").join(by_key, "key").select("doc_id", ROW, (F.struct("doc_id", ROW) == F.col("keeper")).alias("stays"))
    placed = stored(placed, "placed")
    gone = placed.where(~F.col("stays")).select("doc_id", ROW).distinct()
    again = placed.where("stays").groupBy("doc_id", ROW).agg(F.count("*").alias("n")).where(F.col("n") > 1).select("doc_id", ROW)
    name = free_name(docs, "row")
    marked = without_rows(docs.withColumn(name, row_identity()), name, stored(gone, "gone"))
    again = stored(again, "again")
    if again.isEmpty():
        return marked.drop(name)
    once = without_rows(marked, name, again)
    return once.unionByName(with_rows(marked, name, again).dropDuplicates([name, "doc_id"])).drop(name)
