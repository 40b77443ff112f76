"""Neighbour lists of large networks: the lists of a block of nodes are one row of compressed bytes.

Edges are dealt to blocks from both ends and stored once, at some bytes an edge.  What looks at pairs of
lists brings groups of blocks together, which tasks read from where they are stored: no copies are dealt
out; what looks at single lists reads the stored rows.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.session import materialize

#: Blocks of nodes, edges that are packed at once, entries of lists in a group of blocks, and entries that are looked up at once.
BLOCKS, CHUNK, GROUP, AT_ONCE = 96, 1 << 20, 9_000_000, 1 << 21


def squeeze(a: np.ndarray) -> tuple[str, int, bytes]:
    """An array as compressed planes of bytes."""
    planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T)
    return a.dtype.str, len(a), pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True) if len(a) else b""


def restore(packed: tuple[str, int, bytes]) -> np.ndarray:
    kind, n, data = packed
    size = np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    planes = np.frombuffer(pa.Codec("zstd", 1).decompress(data, n * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def squeeze_values(v: np.ndarray) -> tuple:
    """Doubles as whole millionths where that loses nothing."""
    with np.errstate(invalid="ignore", over="ignore"):
        k = np.rint(v * 1e6)
        exact = bool((np.abs(k) < 2**31 - 1).all()) and bool((k / 1e6 == v).all()) and not bool(np.signbit(v[v == 0]).any())
    return (exact, squeeze(k.astype(np.int32) if exact else v))


def restore_values(packed: tuple) -> np.ndarray:
    exact, data = packed
    v = restore(data)
    return v / 1e6 if exact else v


@dataclass
class Lists:
    """Rows ``ids``; the list of row r is ``names[place[start[r]:start[r + 1]]]``, rising, with values where there are any."""

    ids: np.ndarray
    start: np.ndarray
    names: np.ndarray
    place: np.ndarray
    value: np.ndarray | None = None

    def pack(self) -> bytes:
        rises = lambda x: squeeze(np.diff(x, prepend=x.dtype.type(0)))
        return pickle.dumps((rises(self.ids), squeeze(np.diff(self.start)), rises(self.names), rises(self.place.astype(np.int32)), None if self.value is None else squeeze_values(self.value)))

    @staticmethod
    def unpack(data: bytes) -> Lists:
        ids, sizes, names, place, value = pickle.loads(data)
        sums = lambda x: np.cumsum(restore(x), dtype=np.dtype(x[0]))
        return Lists(sums(ids), np.concatenate(([0], np.cumsum(restore(sizes)))), sums(names), sums(place).astype(np.int64), None if value is None else restore_values(value))


def lists_of(i: np.ndarray, j: np.ndarray, v: np.ndarray | None = None) -> Lists:
    """Lists of rows ``i``; a repeated entry is one, with the sum of its values in rising order."""
    order = np.lexsort((j, i) if v is None else (v, j, i))
    i, j = i[order], j[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (j[1:] != j[:-1])
    at = np.flatnonzero(new)
    if v is not None:
        v = np.add.reduceat(v[order], at) if len(at) else v
    i, j = i[at], j[at]
    ids, sizes = np.unique(i, return_counts=True)
    names, place = np.unique(j, return_inverse=True)
    return Lists(ids, np.concatenate(([0], np.cumsum(sizes))), names, place, v)


def home(ids: np.ndarray, blocks: int) -> np.ndarray:
    """The block of a node."""
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % blocks


def _tasks(df: DataFrame) -> int:
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def pack_pieces(held: list[tuple[np.ndarray, ...]], blocks: int, both: bool) -> Iterator[tuple[int, bytes]]:
    """Entries by the block of their row: ``(block, bytes)``."""
    i, j, *rest = (np.concatenate(c) for c in zip(*held, strict=True))
    if both:
        i, j, rest = np.concatenate((i, j)), np.concatenate((j, i)), [np.concatenate((v, v)) for v in rest]
    block = home(i, blocks)
    order = np.lexsort((j, i, block))
    cuts = np.searchsorted(block[order], np.arange(blocks + 1))
    for k in np.flatnonzero(np.diff(cuts)).tolist():
        own = order[cuts[k] : cuts[k + 1]]
        yield k, pickle.dumps((*(squeeze(np.diff(x[own], prepend=0)) for x in (i, j)), *(squeeze_values(v[own]) for v in rest)))


def open_piece(data: bytes) -> tuple[np.ndarray, ...]:
    x, j, *rest = pickle.loads(data)
    return np.cumsum(restore(x)), np.cumsum(restore(j)), *(restore_values(v) for v in rest)


def dealt(edges: DataFrame, value: str | None = None, blocks: int = BLOCKS, both: bool = True) -> DataFrame:
    """``(block, data)``: edges ``(i, j)`` of whole numbers, from both ends, in pieces by the block of their row; not stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for k, data in pack_pieces(held, blocks, both):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data], pa.binary())], ["block", "data"])

        for batch in batches:
            if batch.num_rows:
                held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
                size += batch.num_rows
            if size >= CHUNK:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    columns = [F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")] + ([F.col(value).cast("double").alias("v")] if value else [])
    return edges.where("i is not null and j is not null").select(*columns).mapInArrow(run, "block int, data binary")


def by_block(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows in order of a column of whole numbers, those of a number together."""
    now, held = None, []
    for batch in batches:
        kinds = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(kinds)) + 1).tolist(), len(kinds)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if s == e:
                continue
            if kinds[s] != now:
                if held:
                    yield now, held
                now, held = int(kinds[s]), []
            held.append(batch.slice(s, e - s))
    if held:
        yield now, held


def neighbour_lists(edges: DataFrame, value: str | None = None) -> DataFrame:
    """``(block, entries, data)``, stored: the neighbours of every node, edges taken from both ends; loops go, repeated edges are one (values summed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in by_block(batches):
            parts = [open_piece(d.as_py()) for b in held for d in b.column(1)]
            lists = lists_of(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([len(lists.place)]), pa.array([lists.pack()], pa.binary())], ["block", "entries", "data"])

    pieces = dealt(edges.where("i <> j"), value)
    tasks = min(BLOCKS, _tasks(edges))
    return materialize(pieces.repartitionById(tasks, F.col("block") % tasks).sortWithinPartitions("block").mapInArrow(run, "block int, entries long, data binary"))


def group_pairs(lists: DataFrame, run: Callable[[list[Lists], list[Lists] | None], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Bring every pair of groups of blocks together once, in a task of its own; ``run`` gets the lists of both (None: a group and itself).

    A group is stored as one row and a partition, which every task that needs it reads there.
    """
    total, most = lists.agg(F.sum("entries"), F.count("*")).first()
    least = math.ceil(math.sqrt(2 * lists.sparkSession.sparkContext.defaultParallelism)) if (total or 0) > 500_000 else 1
    groups = max(1, min(most or 1, max(least, -(-(total or 0) // GROUP))))

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, held in by_block(batches):
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([pickle.dumps([d.as_py() for b in held for d in b.column(1)])], pa.binary())], ["g", "lists"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own, far = ([Lists.unpack(d) for d in pickle.loads(x)] if x is not None else None for x in (c[k].as_py() for c in batch.columns))
                yield from run(own, far)

    own = lists.select((F.col("block") % groups).cast("int").alias("g"), "data").repartitionById(groups, "g").sortWithinPartitions("g")
    stored = materialize(own.mapInArrow(bundle, "g int, lists binary"))
    other = stored.select(F.col("g").alias("h"), F.col("lists").alias("far"))
    pairs = stored.hint("shuffle_replicate_nl").join(other, F.col("g") <= F.col("h"))  # a product of partitions, without a shuffle
    return pairs.select("lists", F.when(F.col("g") < F.col("h"), F.col("far")).alias("far")).mapInArrow(each, schema)


def shared_neighbours(own: list[Lists], far: list[Lists] | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(i, j, shared, degree of i, degree of j)`` of the edges between two groups of lists (or within one), each once, i < j."""
    parts = own + (far or [])
    names = np.unique(np.concatenate([p.names for p in parts]))
    ids = np.concatenate([p.ids for p in parts])
    rows: list[np.ndarray] = []
    for p in parts:
        p.place = np.searchsorted(names, p.names)[p.place]
        rows += [p.place[s:e] for s, e in zip(p.start.tolist(), p.start[1:].tolist(), strict=False)]
    degree = np.fromiter(map(len, rows), np.int64, len(rows))
    at = np.searchsorted(names, ids)
    known = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == ids)
    row_of = np.full(len(names), -1)
    row_of[at[known]] = np.flatnonzero(known)
    first = sum(len(p.ids) for p in own)  # the first row of the other group
    r, s, done = [], [], 0
    for p in own:
        x = np.repeat(np.arange(done, done + len(p.ids)), np.diff(p.start))
        y = row_of[p.place]
        want = (y >= first) if far is not None else (y >= 0) & (ids[x] < ids[y])
        r.append(x[want])
        s.append(y[want])
        done += len(p.ids)
    r, s = np.concatenate(r), np.concatenate(s)
    # The longer list is marked, the shorter one is looked up in it.
    swap = degree[r] < degree[s]
    r, s = np.where(swap, s, r), np.where(swap, r, s)
    order = np.argsort(r, kind="stable")
    r, s = r[order], s[order]
    count, mark = np.empty(len(r), np.int32), np.zeros(len(names), np.uint8)
    ends = np.cumsum(degree[s])
    bounds = [0, *(np.flatnonzero(np.diff(r)) + 1).tolist(), len(r)]
    which, told = s.tolist(), 0
    for a, b in zip(bounds, bounds[1:], strict=False):
        if a == b:
            continue
        here = rows[r[a]]
        mark[here] = 1
        while a < b:
            before = ends[a] - degree[s[a]]
            e = min(b, max(a + 1, int(np.searchsorted(ends, before + AT_ONCE, side="right"))))
            found = mark.take(np.concatenate([rows[x] for x in which[a:e]]), mode="clip")
            count[a:e] = np.add.reduceat(found, ends[a:e] - degree[s[a:e]] - before, dtype=np.int32)
            a = e
        mark[here] = 0
        if b - told >= 1 << 17 or b == len(r):
            x, y = r[told:b], s[told:b]
            flip = ids[x] > ids[y]
            x, y = np.where(flip, y, x), np.where(flip, x, y)
            yield ids[x], ids[y], count[told:b], degree[x], degree[y]
            told = b
