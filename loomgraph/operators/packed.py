"""Counts of windows of up to 32 bases, at two bits a base, by their minimizers.

A window's minimizer is the least hash of the short words in it, each taken with its reverse complement, so that a window and
its reverse complement have the same one. Neighbouring windows mostly share theirs: a run of those is one piece of bases, and
pieces are what is shuffled, some 1.2 bytes a window. All windows with one minimizer meet in one bucket, which is counted by
sorting numbers. A bucket of many windows is counted in several passes by a hash of the window, so that memory is that of its
pieces and of one pass.

pieces: bucket, n (windows), lens (of each piece its windows, a byte), w (their bases, each piece from a new byte on), times
(how often each piece was seen, eight bytes, or null for once).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bases of the longest window and of the longest piece.
WINDOW, PIECE = 32, 48
BUCKETS = 4096
#: Bases that are cut into pieces at a time, and windows that are counted at a time.
CHUNK, PASS = 1 << 22, 1 << 22
#: Pieces of a bucket that are held as they came; beyond so many, equal ones become one.
HELD = 1 << 21
#: Windows that buckets are counted together up to, as small ones aren't worth a turn of their own.
TOGETHER = 1 << 18
#: What a window that is asked for counts besides.
ASKED = 1 << 40
#: Rows in an Arrow batch of results.
ROWS = 1 << 16
#: Bits of a node's bucket, and runs that are contracted at a time.
NODE_BITS, NODES = 16, 1 << 19
SCHEMA = "bucket int, n long, lens binary, w binary, times binary"

_BREAK = 4
_Tally = tuple[np.ndarray, np.ndarray]
Finish = Callable[[np.ndarray, np.ndarray], dict[str, pa.Array | np.ndarray]]
u64 = np.uint64


def fits(size: int) -> bool:
    return 4 <= size <= WINDOW


def _codes(letters: str, bases: str, rest: int = 0) -> np.ndarray:
    table = np.full(256, rest, np.uint8)
    for letter, base in zip(letters, bases, strict=True):
        table[ord(letter)] = "ACGT".index(base)
    return table


@lru_cache
def _alphabet(column: str) -> np.ndarray:
    """The code of each byte: of a base in seq, of a letter that stands for one in lines of text."""
    if column == "seq":
        return _codes("ACGT", "ACGT")
    from loomgraph.functions.kmers import AS_BASES, LETTERS

    table = _codes(LETTERS + LETTERS.upper(), AS_BASES * 2)
    table[ord("\n")] = _BREAK
    return table


@lru_cache
def _hashes(m: int) -> np.ndarray:
    """A hash over 0 of each word of m bases, the same for its reverse complement."""
    x = np.arange(4**m, dtype=u64)
    h = (np.minimum(x, opposite(x, m)) + u64(1)) * u64(0x9E3779B97F4A7C15)
    h ^= h >> u64(29)
    h *= u64(0xBF58476D1CE4E5B9)
    return np.maximum((h >> u64(32)).astype(np.uint32), 1)


def opposite(x: np.ndarray, size: int) -> np.ndarray:
    """The reverse complements of codes of size bases."""
    x = ~x
    for by, low in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        x = ((x >> u64(by)) & u64(low)) | ((x & u64(low)) << u64(by))
    return x.byteswap() >> u64(64 - 2 * size)


def _joined_codes(columns: list[pa.Array], column: str) -> tuple[np.ndarray, np.ndarray]:
    """The codes of the bases of all rows, one after another, and where rows begin."""
    parts, starts, at = [], [], 0
    for x in columns:
        x = x.cast(pa.large_binary()) if pa.types.is_string(x.type) or pa.types.is_large_string(x.type) else x
        offsets = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
        data = np.frombuffer(x.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        later = (data & 0xC0) == 0x80  # a character is one base, however many bytes it has
        if later.any():
            offsets = offsets - np.searchsorted(np.flatnonzero(later), offsets)
            data = data[~later]
        parts.append(_alphabet(column)[data])
        starts.append(offsets[:-1] + at)
        at += len(data)
    return np.concatenate(parts), np.concatenate(starts)


def _cut(codes: np.ndarray, starts: np.ndarray, size: int, first: bool = False) -> Iterator[tuple]:
    """(buckets, lens, bytes, number of bytes) of the pieces of a few million bases at a time, by bucket; first: of the first window of each read only."""
    for lo in range(0, max(len(codes) - size + 1, 0), CHUNK):
        part = codes[lo : lo + CHUNK + size - 1]
        own = starts[np.searchsorted(starts, lo, "right") : np.searchsorted(starts, lo + len(part))] - lo
        at = None
        if first:
            at = np.concatenate([starts[starts == lo] - lo, own, np.flatnonzero(codes[max(lo - 1, 0) : lo + len(part)] == _BREAK) + 1 - min(lo, 1)])
        yield _cut_part(part, own, size, at)


def _cut_part(codes: np.ndarray, starts: np.ndarray, size: int, only: np.ndarray | None = None) -> tuple:
    m, n = min(10, size // 2), len(codes)
    breaks = np.flatnonzero(codes == _BREAK)
    c1 = np.zeros(n + 64, np.uint8)
    c1[:n] = codes
    c1[breaks] = 0
    c2 = (c1[:-1] << 2) | c1[1:]
    c4 = (c2[:-2] << 4) | c2[2:]
    c8 = (c4[:-4].astype(np.uint16) << 8) | c4[4:]
    words = c8[:n].astype(np.uint32)
    if m < 8:
        words >>= np.uint32(16 - 2 * m)
    for j in range(8, m):
        words = (words << np.uint32(2)) | c1[j : n + j]
    low = _hashes(m)[words[: n - m + 1]]
    for at, first in ((breaks, 0), (starts, 1)):  # no word goes over a break or into the next row
        for j in range(first, m):
            over = at - j
            low[over[(over >= 0) & (over < len(low))]] = 0
    span, wide = 1, size - m + 1
    while 2 * span <= wide:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    if span < wide:
        low = np.minimum(low[: span - wide], low[wide - span :])
    if only is None:
        new = np.ones(len(low), bool)
        np.not_equal(low[1:], low[:-1], out=new[1:])
        first = np.flatnonzero(new)
        lens = np.diff(np.append(first, len(low)))
    else:
        first = np.unique(only[only < len(low)])
        lens = np.ones(len(first), np.int64)
    low = low[first]
    first, lens, low = (x[low > 0] for x in (first, lens, low))
    most = PIECE - size + 1
    if len(lens) and lens.max() > most:
        times = -(-lens // most)
        of = np.repeat(np.arange(len(lens)), times)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        first, lens, low = first[of] + nth * most, np.minimum(lens[of] - nth * most, most), low[of]
    buckets = ((low.astype(u64) * u64(0x9E3779B97F4A7C15)) >> u64(64 - (BUCKETS - 1).bit_length())).astype(np.uint16)
    order = np.argsort(buckets, kind="stable")
    buckets, lens, first = buckets[order], lens[order].astype(np.uint8), first[order]
    words = np.empty((len(first), PIECE // 8), ">u2")
    for j in range(PIECE // 8):
        words[:, j] = c8[first + 8 * j]
    room = _room(lens, size)
    return buckets, lens, words.view(np.uint8)[np.arange(PIECE // 4) < room[:, None]], room


def _room(lens: np.ndarray, size: int) -> np.ndarray:
    """Bytes of pieces of so many windows."""
    return (lens.astype(np.int64) + (size - 1 + 3)) >> 2


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(ends) + 1, np.int32)
    offsets[1:] = ends
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _batch(columns: dict[str, pa.Array | np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns.values()], list(columns))


def _rows_of_pieces(buckets: np.ndarray, lens: np.ndarray, data: np.ndarray, room: np.ndarray, times: np.ndarray | None = None) -> pa.RecordBatch:
    """A row a bucket; the pieces of a bucket stand together."""
    last = np.flatnonzero(np.append(buckets[1:] != buckets[:-1], True)) if len(buckets) else np.zeros(0, np.int64)
    windows = np.diff(np.cumsum(lens, dtype=np.int64)[last], prepend=0)
    seen = pa.nulls(len(last), pa.binary()) if times is None else _binary(times.astype("<i8").view(np.uint8), 8 * (last + 1))
    columns = [pa.array(buckets[last].astype(np.int32)), pa.array(windows), _binary(lens, last + 1), _binary(data, np.cumsum(room)[last]), seen]
    return pa.RecordBatch.from_arrays(columns, ["bucket", "n", "lens", "w", "times"])


def pieces(reads: DataFrame, size: int, first: bool = False) -> DataFrame:
    """The pieces of reads: of the column seq, or of the lines of the column text, whose letters stand for bases.

    first: of the first window of each read only, seen ASKED times each.
    """
    column = "seq" if "seq" in reads.columns else "text"

    def rows(held: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        for p in _cut(*_joined_codes(held, column), size, first):
            yield _rows_of_pieces(*p, np.full(len(p[1]), ASKED, np.int64) if first else None)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            x = batch.column(0)
            if len(x):
                held.append(x)
                n += x.nbytes
            if n >= CHUNK:
                yield from rows(held)
                held, n = [], 0
        if held:
            yield from rows(held)

    return reads.where(f"{column} IS NOT NULL").select(column).mapInArrow(cut, SCHEMA)


def _windows(lens: np.ndarray, data: np.ndarray, size: int, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """The larger strand of each window of pieces, and how often it was seen (None: once)."""
    rows = np.zeros((len(lens), PIECE // 4), np.uint8)
    rows[np.arange(PIECE // 4) < _room(lens, size)[:, None]] = data
    order = np.argsort(255 - lens, kind="stable")
    rows, lens = rows[order], lens[order]
    a = rows[:, :8].copy().view(">u8").ravel().astype(u64)
    b = rows[:, 8:].copy().view(">u4").ravel().astype(u64) << u64(32)
    left = np.cumsum(np.bincount(lens)[::-1])[::-1][1:]  # pieces with more than j windows
    out, at = np.empty(int(left.sum()), u64), 0
    seen = None if times is None else np.empty(len(out), np.int64)
    down, top = u64(64 - 2 * size), u64(2 * size - 2)
    for j, n in enumerate(left):
        x = a[:n] >> down
        back = opposite(x, size) if j == 0 else (back[:n] >> u64(2)) | (((x & u64(3)) ^ u64(3)) << top)
        np.maximum(x, back, out=out[at : at + n])
        if seen is not None:
            seen[at : at + n] = times[order[:n]]
        at += n
        a = (a[:n] << u64(2)) | (b[:n] >> u64(62))
        b = b[:n] << u64(2)
    return out, seen


def _tally(codes: np.ndarray, times: np.ndarray | None) -> _Tally:
    """Distinct codes in order, and the sums of their times."""
    if times is None:
        codes.sort()
    else:
        order = np.argsort(codes)
        codes, times = codes[order], times[order]
    new = np.ones(len(codes), bool)
    np.not_equal(codes[1:], codes[:-1], out=new[1:])
    first = np.flatnonzero(new)
    if times is None:
        return codes[first], np.diff(np.append(first, len(codes)))
    return codes[first], np.add.reduceat(times, first) if len(first) else times


def _as_one(held: list[tuple], size: int) -> list[tuple]:
    """(lens, bytes, times) of parts of a bucket, with equal pieces as one."""
    lens, data = (np.concatenate([h[i] for h in held]) for i in (0, 1))
    times = np.concatenate([np.ones(len(h[0]), np.int64) if h[2] is None else h[2] for h in held])
    rows = np.zeros((len(lens), 16), np.uint8)
    room = _room(lens, size)
    # bits behind a piece's last base belong to the next one of its read
    rows[:, :12][np.arange(12) < room[:, None]] = data
    spare = (4 * room - (lens.astype(np.int64) + size - 1)).astype(np.uint8)
    at = np.arange(len(lens)), room - 1
    rows[at] = (rows[at] >> (2 * spare)) << (2 * spare)
    rows[:, 15] = lens
    keys = rows.view(u64)
    order = np.lexsort((keys[:, 0], keys[:, 1]))
    keys = keys[order]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
    rows, lens = rows[order[first]], lens[order[first]]
    return [(lens, rows[:, :12][np.arange(12) < room[order[first]][:, None]], np.add.reduceat(times[order], first))]


def _tallies(held: list[tuple], n: int, size: int) -> Iterator[_Tally]:
    """Distinct windows of a bucket's pieces and their counts, each window once, in passes of some PASS windows."""
    passes = -(-n // PASS)
    if passes <= 1:
        some = [None if all(h[2] is None for h in held) else np.concatenate([np.ones(len(h[0]), np.int64) if h[2] is None else h[2] for h in held])]
        yield _tally(*_windows(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), size, *some))
        return
    step = PASS // (PIECE - size + 1)
    for turn in range(passes):
        done: _Tally | None = None
        codes, times, waiting = [], [], 0

        def gathered(done=None):
            all_times = None if done is None and all(t is None for t in times) else np.concatenate([np.ones(len(c), np.int64) if t is None else t for c, t in zip(codes, times, strict=True)] + ([] if done is None else [done[1]]))
            return _tally(np.concatenate(codes + ([] if done is None else [done[0]])), all_times)

        for lens, data, seen in held:
            ends = np.append(0, np.cumsum(_room(lens, size)))
            for i in range(0, len(lens), step):
                j = min(i + step, len(lens))
                x, t = _windows(lens[i:j], data[ends[i] : ends[j]], size, None if seen is None else seen[i:j])
                own = ((x * u64(0xD1342543DE82EF95)) >> u64(40)) % u64(passes) == turn
                codes.append(x[own])
                times.append(None if t is None else t[own])
                waiting += len(codes[-1])
                if waiting >= 2 * PASS:
                    done = gathered(done)
                    codes, times, waiting = [], [], 0
        if codes or done is not None:
            yield gathered(done) if codes else done


def _buckets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, list[tuple], int]]:
    """(bucket, its parts, their windows) of rows of pieces in the order of their buckets."""
    now, held, n, count, most = -1, [], 0, 0, HELD
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for i, j in zip(*(lambda cuts: (cuts[:-1], cuts[1:]))(np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1], [True]])) if len(ids) else np.zeros(1, int)), strict=True):
            if ids[i] != now:
                if held:
                    yield now, held, n
                now, held, n, count, most = int(ids[i]), [], 0, 0, HELD
            n += int(batch.column(1)[i:j].to_numpy().sum())
            lens, data = (_bytes(batch.column(c)[i:j]) for c in (2, 3))
            seen = batch.column(4)[i:j]
            if seen.null_count == len(seen):
                held.append((lens, data, None))
            else:
                for r in range(i, j):
                    s = batch.column(4)[r].as_py()
                    held.append((_bytes(batch.column(2)[r : r + 1]), _bytes(batch.column(3)[r : r + 1]), None if s is None else np.frombuffer(s, "<i8")))
            count += len(lens)
            if count > most:
                held = _as_one(held, size)
                count = len(held[0][0])
                n, most = int(held[0][0].sum(dtype=np.int64)), max(HELD, 2 * count)
    if held:
        yield now, held, n


def _groups(buckets: Iterator[tuple[int, list[tuple], int]]) -> Iterator[tuple[list[tuple], int]]:
    """The parts of one bucket, or of several small ones, and their windows."""
    held, n = [], 0
    for _, more, windows in buckets:
        if held and n + windows > TOGETHER:
            yield held, n
            held, n = [], 0
        held, n = held + more, n + windows
    if held:
        yield held, n


def _bytes(column: pa.Array) -> np.ndarray:
    """The bytes of all rows of a binary column."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]


def _met(cut: DataFrame) -> DataFrame:
    """pieces with those of a bucket together, in order, in one task."""
    return cut.select("bucket", "n", "lens", "w", "times").repartition("bucket").sortWithinPartitions("bucket")


def tallied(cut: DataFrame, size: int, finish: Finish, schema: str) -> DataFrame:
    """What finish makes of distinct windows (codes of their larger strands) and their counts; it gets each window once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, n in _groups(_buckets(batches, size)):
            for codes, times in _tallies(held, n, size):
                for i in range(0, len(codes), ROWS):
                    yield _batch(finish(codes[i : i + ROWS], times[i : i + ROWS]))

    return _met(cut).mapInArrow(count, schema)


def merged(cut: DataFrame, size: int) -> DataFrame:
    """pieces with equal ones of a bucket as one."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, held, _ in _buckets(batches, size):
            lens, data, times = _as_one(held, size)[0]
            yield _rows_of_pieces(np.full(len(lens), bucket, np.uint16), lens, data, _room(lens, size), times)

    return _met(cut).mapInArrow(merge, SCHEMA)


@lru_cache
def _four() -> np.ndarray:
    """The letters of four bases, by their code."""
    x = np.arange(256)
    return np.ascontiguousarray(np.frombuffer(b"ACGT", np.uint8)[np.stack([(x >> s) & 3 for s in (6, 4, 2, 0)], axis=1)]).view(np.uint32).ravel()


def spelled(codes: np.ndarray, size: int) -> pa.Array:
    """The strings of codes of size bases."""
    n, width = len(codes), -(-size // 4)
    packed = (codes << u64(64 - 2 * size)).astype(">u8").view(np.uint8).reshape(n, 8)[:, :width]
    letters = _four()[packed].view(np.uint8)[:, :size]
    offsets = np.arange(n + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(letters))])


def arcs(codes: np.ndarray, times: np.ndarray, size: int, least: int, most: int) -> dict[str, np.ndarray]:
    """src, arc_idx, mult (at most most), end of the arcs of runs of size bases that are seen least times: codes of the k-mer
    an arc leaves, in its larger strand, and of that it reaches as it is written. A run that is its own reverse complement is one arc, counted twice."""
    if least > 2:
        some = 2 * times >= least
        codes, times = codes[some], times[some]
    back = opposite(codes, size)
    own = codes == back
    mult = np.minimum(np.where(own, 2 * times, times), most)
    kept = mult >= least
    codes, back, own, mult = (x[kept] for x in (codes, back, own, mult))
    low = u64((1 << (2 * size - 2)) - 1)
    two_of = np.stack([np.ones(len(own), bool), ~own], axis=1).ravel() if own.any() else slice(None)
    two = lambda a, b: np.stack([a, b], axis=1).ravel()[two_of]
    e, o = two(codes, back), two(back, codes)
    start, other = e >> u64(2), o & low
    slot = (e & u64(3)).astype(np.int32) + np.where(start >= other, 0, 4).astype(np.int32)
    return {"src": np.maximum(start, other), "arc_idx": slot, "mult": two(mult, mult), "end": e & low}


def bins(codes: np.ndarray, times: np.ndarray, size: int, top: int) -> np.ndarray:
    """How many arcs runs of size bases make of each multiplicity, of which top stands for more, too."""
    own = codes == opposite(codes, size)
    n = 2 * np.bincount(np.minimum(times, top), minlength=top + 1)
    if own.any():
        n -= 2 * np.bincount(np.minimum(times[own], top), minlength=top + 1)
        n += np.bincount(np.minimum(2 * times[own], top), minlength=top + 1)
    return n


def node_buckets(codes: np.ndarray, size: int) -> np.ndarray:
    """A bucket of each k-mer (code of either strand), by its minimizer."""
    m = min(10, size // 2)
    table, mask = _hashes(m), u64(4**m - 1)
    low = np.full(len(codes), 1 << 32, u64)
    for j in range(size - m + 1):
        np.minimum(low, table[(codes >> u64(2 * j)) & mask], out=low)
    return ((low * u64(0x9E3779B97F4A7C15)) >> u64(64 - NODE_BITS)).astype(np.int32)


def runs_by_end(cut: DataFrame, size: int, least: int, most: int) -> DataFrame:
    """bucket, code, mult (at most most) of runs that are seen least times, once for the bucket of each k-mer at its ends."""

    def finish(codes: np.ndarray, times: np.ndarray) -> dict[str, np.ndarray]:
        some = 2 * times >= least
        codes, times = codes[some], times[some]
        mult = np.minimum(np.where(codes == opposite(codes, size), 2 * times, times), most)
        codes, mult = codes[mult >= least], mult[mult >= least]
        first, last = (node_buckets(x, size - 1) for x in (codes >> u64(2), codes & u64((1 << (2 * size - 2)) - 1)))
        other = first != last
        return {"bucket": np.concatenate([first, last[other]]), "code": np.concatenate([codes, codes[other]]).view(np.int64), "mult": np.concatenate([mult, mult[other]]).astype(np.int32)}

    return tallied(cut, size, finish, "bucket int, code long, mult int")


def contracted(runs: DataFrame, size: int) -> DataFrame:
    """Stretches of arcs, joined at nodes with one arc on each side as far as the nodes of some buckets reach; each arc is in one.

    runs: of runs_by_end(). start, end: codes of the first and last k-mer as the stretch is written; stays: whether the first
    one is a node that stays; the columns of arcs; mults (of each arc, a byte). A circle that is seen as one is left as single arcs.
    """

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            rows = [x.to_numpy() for x in batch.columns]
            # all rows of a bucket are needed, so the last one waits for the next batch
            while n + len(rows[0]) >= NODES:
                cuts = np.flatnonzero(rows[0][1:] != rows[0][:-1]) + 1
                if held and len(rows[0]) and held[-1][0][-1] != rows[0][0]:
                    cuts = np.append(0, cuts)
                if not len(cuts):
                    break
                at = cuts[min(int(np.searchsorted(cuts, NODES - n)), len(cuts) - 1)]
                yield from _contract(held + [[x[:at] for x in rows]], size)
                held, n, rows = [], 0, [x[at:] for x in rows]
            if len(rows[0]):
                held.append(rows)
                n += len(rows[0])
        if held:
            yield from _contract(held, size)

    met = runs.repartition("bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(contract, "start long, end long, stays boolean, src string, arc_idx int, seq string, len long, cov long, dst string, dst_pos boolean, mults binary")


def _contract(held: list, size: int) -> Iterator[pa.RecordBatch]:
    buckets, codes, mult = (np.concatenate([h[i] for h in held]) for i in range(3))
    here = np.zeros(1 << NODE_BITS, bool)
    here[buckets] = True
    codes, first = np.unique(codes.view(u64), return_index=True)
    mult, k, low = mult[first], size - 1, u64((1 << (2 * size - 2)) - 1)
    back = opposite(codes, size)
    both = np.flatnonzero(codes != back)
    n = len(codes)
    twin = np.arange(n)
    twin[both] = n + np.arange(len(both))
    twin = np.append(twin, both)
    arcs_, mult = np.append(codes, back[both]), np.append(mult, mult[both])
    start, end = arcs_ >> u64(2), arcs_ & low
    order = np.argsort(start, kind="stable")
    nodes, at, of, count = np.unique(start[order], return_index=True, return_inverse=True, return_counts=True)
    degree, found = np.empty(len(start), np.int64), np.searchsorted(nodes, opposite(start, k))
    degree[order] = count[of]
    found = np.minimum(found, len(nodes) - 1)
    there = nodes[found] == opposite(start, k)
    partner = order[at[found]]  # an arc that leaves the node on its other side, if there is one
    own = larger(end, k) == larger(start, k)
    owned = here[node_buckets(start, k)]
    passed = owned & (degree == 1) & there & (count[found] == 1) & ~own & ~own[partner]
    before = np.where(passed, twin[partner], -1)
    before[before >= 0] = np.where(owned[before[before >= 0]], before[before >= 0], -1)
    of = np.flatnonzero(owned)
    head, place = _ranked(before)
    rows = of[np.lexsort((place[of], head[of]))]
    if not len(rows):
        return
    begin = np.flatnonzero(place[rows] == 0)
    ends = np.append(begin[1:], len(rows))
    letters, weights = np.frombuffer(b"ACGT", np.uint8)[(end[rows] & u64(3)).astype(np.int64)], mult[rows]
    cov = np.add.reduceat(weights.astype(np.int64), begin)
    weights = weights.astype(np.uint8)
    for i in range(0, len(begin), ROWS):
        lo, hi = begin[i : i + ROWS], ends[i : i + ROWS]
        data, offsets = slice(lo[0], hi[-1]), hi - lo[0]
        a, z = rows[lo], rows[hi - 1]
        seq = _binary(letters[data], offsets)
        src, dst = larger(start[a], k), larger(end[z], k)
        slot = (end[a] & u64(3)).astype(np.int32) + np.where(start[a] == src, 0, 4).astype(np.int32)
        named = {"src": spelled(src, k), "arc_idx": slot, "seq": seq.cast(pa.string()), "len": hi - lo, "cov": cov[i : i + ROWS], "dst": spelled(dst, k), "dst_pos": end[z] == dst}
        yield _batch({"start": start[a].view(np.int64), "end": end[z].view(np.int64), "stays": ~passed[a]} | named | {"mults": _binary(weights[data], offsets)})


def _ranked(before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the first of its chain and its place in that, from the row before it (-1: none). Rows of a circle stand alone."""
    ptr = np.where(before >= 0, before, np.arange(len(before)))
    place = (before >= 0).astype(np.int64)
    for _ in range(max(1, len(before)).bit_length()):
        if not place[ptr].any():
            break
        place, ptr = place + place[ptr], ptr[ptr]
    round_ = before[ptr] >= 0
    ptr[round_], place[round_] = np.flatnonzero(round_), 0
    return ptr, place


def partition_hashes(codes: np.ndarray, size: int) -> np.ndarray:
    """partition_hash() of k-mers."""
    small, out = np.minimum(codes, opposite(codes, size)), np.zeros(len(codes), u64)
    for j in range(-(-size // 4)):
        out = (out * u64(19) + ((small >> u64(8 * j)) & u64(255))) & u64(0xFFFFFFFF)
    return out.astype(np.int64)


def larger(codes: np.ndarray, size: int) -> np.ndarray:
    """The canonical forms of codes of size bases."""
    return np.maximum(codes, opposite(codes, size))


def base(slot: np.ndarray) -> np.ndarray:
    """The code of the base that an arc in a slot adds."""
    return (slot % 4).astype(u64)


def ones(n: int) -> np.ndarray:
    return np.ones(n, np.int64)
