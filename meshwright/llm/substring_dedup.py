"""Repeated substrings by prefix-free parsing.

A rolling hash over ``TRIGGER`` bytes picks triggers: of every ``LENGTH``-byte window, the least hash.
Triggers cut a text into phrases; a phrase is taken with the bytes that its windows reach, so that
every window lies within the phrase of its own trigger, and equal windows have equal triggers at
the same offset.  The steps over the corpus:

1. Parse.  Every text is parsed where it stands; each phrase becomes a row of its trigger's hash, its
   own hash and its place, (document, start).  Copies of a phrase within a chunk are settled at once.
2. Dictionary.  Rows meet by trigger.  Of equal phrases the first place is the dictionary's; all
   windows of the others start earlier elsewhere and are covered whole.  Phrases whose trigger no
   other phrase has cannot share a window with any and are done; the same holds for the windows on
   one side, where no other phrase has the same ``SIDE`` bytes on that side of the trigger.
3. Suffix arrays.  Dictionary phrases that share a trigger meet with their bytes.  Sorted byte by byte
   from the trigger on, and from the trigger back, they get the ranks of their suffixes and of their
   reversed prefixes to every depth that a window can have; a window is the pair of its ranks on
   either side.  The bytes of the parse beyond a phrase are part of it, so that these ranks order
   the parse as well, to the depth of a window.  Within a rank corpus order decides: the first place
   stays, the others are covered.
4. Covered bytes are cut out of every text.

A trigger of more phrases than a task should hold (``SENT`` in a chunk, ``HELD`` in all) is not brought
together: its windows are dealt out by a 96-bit hash of their bytes, and corpus order decides there.

A string counts as repeated if it starts earlier: in a document of smaller id, or earlier in the
same one.  Rows without an id come last.  Rows that share an id (or have none) are documents of
their own, in the order of a hash of their text; of rows that repeat both, the first is treated as
all others are, and the later ones are covered.  Null texts count as empty; texts under ``LENGTH``
bytes keep all.  A text is parsed whole, whatever its length; extra columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.llm._common import materialize, text_bytes
from meshwright.llm._rolling import prefix, scramble, stretches

LENGTH, TRIGGER = 100, 32
REACH = LENGTH - TRIGGER
SIDE = REACH // 2
#: Bytes parsed together, phrases of one trigger that a chunk sends on, rows of a trigger or window that a task holds, and phrases ranked together.
CHUNK, SENT, HELD, RANKED = 2 << 20, 64, 100_000, 30_000
#: Rows of a phrase; of windows to be ranked with their trigger's others; of windows dealt out by their bytes; of bytes to be cut.
PHRASE, ALIGNED, WINDOW, COVERED = 0, 1, 2, 3
#: n: windows, and for phrases also 128 times the trigger's place among them; p: hashes of both sides of the trigger, or its place.
_NAMES = ["kind", "k", "h", "id", "t", "lo", "n", "p"]
_SCHEMA = "kind int, k long, h long, id long, t long, lo long, n int, p long"
_LAST = (1 << 63) - 1
_Doc = tuple[np.ndarray, np.ndarray]


def _rows(kind: int, k, h, doc: _Doc, lo, n, p=0, data=None) -> pa.RecordBatch:
    count = len(lo)
    whole = lambda v, t: pa.array(np.full(count, v, t) if np.isscalar(v) else np.ascontiguousarray(v).astype(t, copy=False))
    signed = lambda v: v if np.isscalar(v) else np.ascontiguousarray(v).view("<i8")
    cols = [whole(kind, np.int32), whole(signed(k), np.int64), whole(signed(h), np.int64), *(whole(x, np.int64) for x in doc), whole(lo, np.int64), whole(n, np.int32), whole(signed(p), np.int64)]
    return pa.RecordBatch.from_arrays([*cols, *([pa.array(data, pa.binary())] if data is not None else [])], [*_NAMES, *(["data"] if data is not None else [])])


def _spread(doc: _Doc, lo: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return scramble(doc[0].view(np.uint64) + doc[1].view(np.uint64) + np.asarray(lo, np.int64).view(np.uint64))


def _covered(doc: _Doc, lo: np.ndarray, n) -> pa.RecordBatch:
    return _rows(COVERED, _spread(doc, lo), 0, doc, lo, n)


def _windows(doc: _Doc, lo: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return _rows(WINDOW, _spread(doc, lo), 0, doc, lo, n)


def _at(doc: _Doc, pick: np.ndarray) -> _Doc:
    return doc[0][pick], doc[1][pick]


def _lay(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end, and where each begins."""
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def phrases(raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """Trigger hash, phrase hash, text number, start in the text, windows and place of the trigger, and side hashes of every phrase."""
    n, span = len(raw), REACH + 1
    sums = prefix(raw)
    grams = n - TRIGGER + 1
    at = np.arange(grams, dtype=np.int64)
    gram = stretches(sums, at, at + TRIGGER)
    bits = max(1, int(grams).bit_length())
    low = np.uint64((1 << bits) - 1)
    packed = (gram & ~low) | at.astype(np.uint64)
    # The least trigger of each window: least of the tail of one block and the head of the next.
    blocks = -(-grams // span) * span
    padded = np.full(blocks, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:grams] = packed
    grid = padded.reshape(-1, span)
    head = np.minimum.accumulate(grid, axis=1).reshape(-1)
    tail = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    starts = np.concatenate([np.arange(s, e - LENGTH + 1, dtype=np.int64) for s, e in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True) if e - s >= LENGTH])
    chosen = (np.minimum(tail[starts], head[starts + span - 1]) & low).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1))))
    first, last = starts[cut], starts[np.concatenate((cut[1:] - 1, [len(starts) - 1]))]
    trigger = chosen[cut]
    whole = stretches(sums, first, last + LENGTH)
    with np.errstate(over="ignore"):
        whole = scramble(whole + (trigger - first).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    text = np.searchsorted(begins, first, "right") - 1
    half = np.uint64(0xFFFFFFFF)
    left = stretches(sums, np.maximum(trigger - SIDE, first), trigger + TRIGGER) & half
    right = stretches(sums, trigger, np.minimum(trigger + TRIGGER + SIDE, last + LENGTH)) & half
    return gram[trigger], whole, text, first - begins[text], (trigger - first) * 128 + last - first + 1, (left << np.uint64(32)) | right


def _first_of(order_keys: tuple[np.ndarray, ...], doc: _Doc, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys, then place; which rows open a group, and the row that opens each row's group."""
    order = np.lexsort((lo, doc[1], doc[0], *order_keys[::-1]))
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = np.any([key[order][1:] != key[order][:-1] for key in order_keys], axis=0)
    opener = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order, new, opener


def _later(doc: _Doc, lo: np.ndarray, opener: np.ndarray) -> np.ndarray:
    """Rows whose place comes after that of their group's first."""
    return (doc[0] != doc[0][opener]) | (doc[1] != doc[1][opener]) | (lo != lo[opener])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def one(keys: list[tuple[int, int]], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        if max(map(len, texts)) < LENGTH:
            return
        raw, begins = _lay(texts)
        k, h, text, lo, n, p = phrases(raw, begins)
        doc = tuple(np.array(x, np.int64)[text] for x in zip(*keys, strict=True))
        order, new, opener = _first_of((k, h), doc, lo)
        k, h, lo, n, p = (x[order] for x in (k, h, lo, n, p))
        doc = _at(doc, order)
        again = _later(doc, lo, opener)
        if again.any():
            yield _covered(_at(doc, again), lo[again], n[again] % 128 + LENGTH - 1)
        k, h, lo, n, p = (x[new] for x in (k, h, lo, n, p))
        doc = _at(doc, new)
        run = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        width = np.diff(np.concatenate((run, [len(k)])))
        many = np.repeat(width, width) > SENT
        if many.any():  # its windows are wanted in any case; a row without windows tells the others so
            yield _windows(_at(doc, many), lo[many], n[many] % 128)
            opens = np.zeros(len(k), bool)
            opens[run] = True
            opens &= many
            yield _rows(PHRASE, k[opens], 0, _at(doc, opens), lo[opens], 0)
        yield _rows(PHRASE, k[~many], h[~many], _at(doc, ~many), lo[~many], n[~many], p[~many])

    for batch in batches:
        keys, texts, held = [], [], 0
        for i, digest, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if texts and held + len(text) > CHUNK:
                yield from one(keys, texts)
                keys, texts, held = [], [], 0
            keys.append((i, digest))
            texts.append(text)
            held += len(text)
        if texts:
            yield from one(keys, texts)


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in range(len(_NAMES))]


def _by_runs(batches: Iterator[pa.RecordBatch], settle, squeeze, least: int = 1) -> Iterator[pa.RecordBatch]:
    """Pass rows sorted by ``k`` to ``settle`` in whole runs of ``k``, at least ``least`` rows at once; what is held of a longer run than HELD goes through ``squeeze``, which returns what is left of it and what it settles."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _columns(batch)
        if batch.num_columns > len(_NAMES):
            rows.append(np.array(batch.column(len(_NAMES)).to_pylist(), object))
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        last = rows[1] == rows[1][-1]
        whole = len(last) - int(last[::-1].argmin()) if not last.all() else 0
        if whole < least and len(last) - whole <= HELD:
            whole = 0
        held = [x[whole:] for x in rows]
        if whole:
            yield from settle([x[:whole] for x in rows])
        if len(held[0]) > HELD and (held[1] == held[1][-1]).all():
            held, out = squeeze(held)
            yield from out
    if held is not None:
        yield from settle(held)


def _dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def distinct(rows: list[np.ndarray]) -> tuple[list[np.ndarray], list[pa.RecordBatch]]:
        """First places of equal phrases; the others are covered, rows of other kinds pass."""
        kind, out = rows[0], []
        for other in (WINDOW, COVERED):
            if (pick := kind == other).any():
                k, h, i, d, lo, n, p = (x[pick] for x in rows[1:])
                out.append(_rows(other, k, h, (i, d), lo, n, p))
        k, h, i, d, lo, n, p = (x[kind == PHRASE] for x in rows[1:])
        order, new, opener = _first_of((k, h), (i, d), lo)
        k, h, i, d, lo, n, p = (x[order] for x in (k, h, i, d, lo, n, p))
        again = _later((i, d), lo, opener) & (n > 0)
        if again.any():
            out.append(_covered((i[again], d[again]), lo[again], n[again] % 128 + LENGTH - 1))
        return [np.zeros(int(new.sum()), np.int32), *(x[new] for x in (k, h, i, d, lo, n, p))], out

    def squeeze(rows: list[np.ndarray]) -> tuple[list[np.ndarray], list[pa.RecordBatch]]:
        rows, out = distinct(rows)
        if len(rows[0]) <= HELD // 2:
            return rows, out
        # Too many phrases of one trigger: their windows are dealt out, and a row without windows tells those to come.
        _, k, h, i, d, lo, n, p = rows
        own = n > 0
        out.append(_windows((i[own], d[own]), lo[own], n[own] % 128))
        first = [x[:1] for x in rows]
        first[2], first[6] = np.zeros(1, np.int64), np.zeros(1, np.int32)
        return first, out

    def settle(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rows, out = distinct(rows)
        yield from out
        _, k, _, i, d, lo, n, p = rows
        told = np.isin(k, np.unique(k[n == 0]))[n > 0]
        k, i, d, lo, n, p = (x[n > 0] for x in (k, i, d, lo, n, p))
        if not len(k):
            return
        n = n.astype(np.int64)
        place, n = n // 128, n % 128
        on_left, on_right = place >= SIDE, place - n + 1 < SIDE  # sides on which it has windows
        p = p.view("<u8")
        left = on_left & (told | _shared(k, p >> np.uint64(32), on_left))
        right = on_right & (told | _shared(k, p & np.uint64(0xFFFFFFFF), on_right))
        # Windows with SIDE bytes or more before the trigger come first.
        ahead = np.where(on_left, place - SIDE + 1, 0).clip(0, n)
        begin = np.where(left, 0, ahead)
        end = np.where(right, n, ahead)
        for kind, pick in ((ALIGNED, (end > begin) & ~told), (WINDOW, (end > begin) & told)):
            if pick.any():
                yield _rows(kind, k[pick], 0, (i[pick], d[pick]), (lo + begin)[pick], (end - begin)[pick], (place - begin)[pick])

    yield from _by_runs(batches, settle, squeeze)


def _shared(k: np.ndarray, side: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Which rows have another one of the same trigger with the same bytes on a side."""
    out = np.zeros(len(k), bool)
    at = np.flatnonzero(there)
    at = at[np.lexsort((side[at], k[at]))]
    same = (k[at][1:] == k[at][:-1]) & (side[at][1:] == side[at][:-1])
    out[at[1:][same]] = True
    out[at[:-1][same]] = True
    return out


def _ranges(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All of lo, lo+1, .. lo+n-1 for each pair."""
    total = np.cumsum(n)
    return np.repeat(lo - (total - n), n) + np.arange(int(total[-1]), dtype=np.int64)


def _with_text(batches: Iterator[pa.RecordBatch], use) -> Iterator[pa.RecordBatch]:
    """Call ``use(key, own id, data, spans, repeat)`` for each text row; rows come sorted by (id, digest), spans before texts."""
    current, spans, texts = None, [], 0
    for batch in batches:
        for i, digest, is_text, own, data, *span in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (i, digest) != current:
                current, spans, texts = (i, digest), [], 0
            if not is_text:
                spans.append(span)
            else:
                yield from use(current, own, data, spans, texts > 0)
                texts += 1


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of aligned phrases, and hashes of windows that are dealt out."""
    pending: list[tuple[np.ndarray, ...]] = []
    aligned: list[tuple] = []
    size = weight = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal size, weight
        if aligned:
            k, i, d, lo, n, p, data = zip(*aligned, strict=True)
            column = lambda x, t=np.int64: np.array(x, t)
            yield _rows(ALIGNED, column(k), 0, (column(i), column(d)), column(lo), column(n, np.int32), column(p), data)
            aligned.clear()
        if pending:
            k, h, i, d, lo = (np.concatenate(x) for x in zip(*pending, strict=True))
            pending.clear()
            order, new, opener = _first_of((k, h), (i, d), lo)
            k, h, i, d, lo = (x[order] for x in (k, h, i, d, lo))
            again = _later((i, d), lo, opener)
            none = lambda x: [None] * int(x.sum())
            if again.any():
                at = (i[again], d[again])
                yield _rows(COVERED, _spread(at, lo[again]), 0, at, lo[again], LENGTH, 0, none(again))
            yield _rows(WINDOW, k[new], h[new], (i[new], d[new]), lo[new], 1, 0, none(new))
        size = weight = 0

    def use(key: tuple[int, int], own: int | None, data: bytes, spans: list, repeat: bool) -> Iterator[pa.RecordBatch]:
        nonlocal size, weight
        if repeat or not spans:
            return
        for kind, k, lo, n, p in spans:
            if kind == ALIGNED:
                aligned.append((k, *key, lo, n, p, data[lo : lo + n + LENGTH - 1]))
                weight += n + LENGTH
        if any(s[0] == WINDOW for s in spans):
            lo, n = np.array([(s[2], s[3]) for s in spans if s[0] == WINDOW], np.int64).T
            start = np.unique(_ranges(lo, n))
            raw = np.frombuffer(data, np.uint8)
            a, b = prefix(raw), prefix(_OTHER[raw])
            k = stretches(a, start, start + LENGTH)
            h = stretches(b, start, start + LENGTH) & np.uint64(0xFFFFFFFF)
            pending.append((k, h, np.full(len(start), key[0], np.int64), np.full(len(start), key[1], np.int64), start))
            size += len(start)
        if size > 400_000 or weight > CHUNK:
            yield from flush()

    yield from _with_text(batches, use)
    yield from flush()


#: A second reading of bytes, for the second half of a window's hash.
_OTHER = ((np.arange(256, dtype=np.uint32) * 40503 + 12345) % 65521).astype(np.uint32)


def _dense(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks of rows of ``columns`` in lexicographic order."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), np.int64)
    new[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def ranks(first: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Row d: ranks of the phrases by ``first``, then the first d of their ``signs`` (one row per depth)."""
    out = np.empty((len(signs) + 1, len(first)), np.int32)
    rank = out[0] = _dense(first)
    for d, sign in enumerate(signs, 1):
        _, rank = np.unique(rank.astype(np.int64) * 512 + sign, return_inverse=True)
        out[d] = rank
    return out


def repeated_windows(k: np.ndarray, doc: _Doc, lo: np.ndarray, n: np.ndarray, place: np.ndarray, data: list[bytes]) -> tuple[_Doc, np.ndarray]:
    """Windows that start after an equal one, by the suffix arrays of phrases aligned at their triggers."""
    m = len(k)
    raw, begins = _lay(data)
    raw = np.concatenate((raw, np.zeros(LENGTH, np.uint8))).astype(np.int64)
    at = begins[:-1] + place  # the trigger
    depth = np.arange(1, REACH + 1)[:, None]
    back, ahead = at - depth, at + TRIGGER - 1 + depth
    left = np.where(back >= begins[:-1], raw[np.maximum(back, 0)], 256)
    right = np.where(ahead < begins[1:], raw[np.minimum(ahead, len(raw) - 1)], 256)
    trigger = raw[at + np.arange(TRIGGER)[:, None]]
    words = [sum(trigger[b + s] << (8 * s) for s in range(6)) for b in range(0, 30, 6)] + [trigger[30] << 8 | trigger[31]]
    same = _dense(k, *words)
    before, after = ranks(same, left), ranks(same, right)
    phrase = np.repeat(np.arange(m), n)
    start = _ranges(np.zeros(m, np.int64), n)
    offset = place[phrase] - start
    name = (before[offset, phrase].astype(np.int64) << 32) | after[REACH - offset, phrase]
    name = name * np.int64(128) + offset if m < 1 << 24 else _dense(offset, name)
    _, name, count = np.unique(name, return_inverse=True, return_counts=True)
    some = np.flatnonzero(count[name] > 1)
    name, start, phrase = name[some], start[some], phrase[some]
    own, begin = _at(doc, phrase), lo[phrase] + start
    order, _, opener = _first_of((name,), own, begin)
    own, begin = _at(own, order), begin[order]
    again = _later(own, begin, opener)
    return _at(own, again), begin[again]


def _stretches_of(doc: _Doc, lo: np.ndarray) -> pa.RecordBatch:
    """Covered windows, those that overlap in one document as one stretch."""
    order = np.lexsort((lo, doc[1], doc[0]))
    doc, lo = _at(doc, order), lo[order]
    gap = np.flatnonzero(np.concatenate(([True], (doc[0][1:] != doc[0][:-1]) | (doc[1][1:] != doc[1][:-1]) | (lo[1:] > lo[:-1] + LENGTH))))
    end = np.concatenate((gap[1:], [len(lo)])) - 1
    return _covered(_at(doc, gap), lo[gap], lo[end] + LENGTH - lo[gap])


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def firsts(rows: list[np.ndarray]) -> tuple[list[np.ndarray], list[pa.RecordBatch]]:
        """The first place of each window that is dealt out by its bytes; the others are covered."""
        kind, out = rows[0], []
        if (pick := kind == COVERED).any():
            k, h, i, d, lo, n, p = (x[pick] for x in rows[1:8])
            out.append(_rows(COVERED, k, h, (i, d), lo, n, p))
        kind, k, h, i, d, lo, n, p, data = (x[kind == WINDOW] for x in rows)
        order, new, opener = _first_of((k, h), (i, d), lo)
        kind, k, h, i, d, lo, n, p, data = (x[order] for x in (kind, k, h, i, d, lo, n, p, data))
        again = _later((i, d), lo, opener)
        if again.any():
            out.append(_stretches_of((i[again], d[again]), lo[again]))
        return [x[new] for x in (kind, k, h, i, d, lo, n, p, data)], out

    def squeeze(rows: list[np.ndarray]) -> tuple[list[np.ndarray], list[pa.RecordBatch]]:
        aligned = rows[0] == ALIGNED
        rest, out = firsts(rows)
        return [np.concatenate((a[aligned], b)) for a, b in zip(rows, rest, strict=True)], out

    def settle(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        yield from firsts(rows)[1]
        _, k, _, i, d, lo, n, p, data = (x[rows[0] == ALIGNED] for x in rows)
        run = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
        begin = 0
        while begin < len(k):  # whole runs, some RANKED phrases at once
            later = run[run >= begin + RANKED]
            end = int(later[0]) if len(later) else len(k)
            part = slice(begin, end)
            doc, lo_again = repeated_windows(k[part], (i[part], d[part]), lo[part], n[part].astype(np.int64), p[part], list(data[part]))
            if len(lo_again):
                yield _stretches_of(doc, lo_again)
            begin = end

    yield from _by_runs(batches, settle, squeeze, RANKED)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    held = 0
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def use(key: tuple[int, int], own: int | None, data: bytes, spans: list, repeat: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        kept, removed, runs = data, 0, 0
        if repeat and len(data) >= LENGTH:
            kept, removed, runs = b"", len(data), 1
        elif spans:
            lo, n = np.array([s[2:4] for s in spans], np.int64).T
            edge = np.bincount(lo, minlength=len(data) + 1) - np.bincount(lo + n, minlength=len(data) + 1)
            inside = np.cumsum(edge[: len(data)]) > 0
            removed = int(inside.sum())
            runs = int((np.diff(inside.astype(np.int8), prepend=0) == 1).sum())
            kept = np.frombuffer(data, np.uint8)[~inside].tobytes()
        out.append((own, len(data), removed, runs, hashlib.sha256(kept).hexdigest(), kept))
        held += len(kept)
        if held > CHUNK or len(out) >= 5000:
            yield flush()

    def flush() -> pa.RecordBatch:
        nonlocal held
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
        out.clear()
        held = 0
        return batch

    yield from _with_text(batches, use)
    if out:
        yield flush()


def _beside_text(source: DataFrame, spans: DataFrame) -> DataFrame:
    """Texts and their spans by document, spans first."""
    nothing = lambda t: F.lit(None).cast(t)
    texts = source.select("id", "t", F.lit(True).alias("is_text"), "own", "data", *(nothing(t).alias(c) for c, t in (("kind", "int"), ("k", "long"), ("lo", "long"), ("n", "int"), ("p", "long"))))
    marks = spans.select("id", "t", F.lit(False).alias("is_text"), nothing("long").alias("own"), nothing("binary").alias("data"), "kind", "k", "lo", "n", "p")
    return marks.unionByName(texts).repartition("id", "t").sortWithinPartitions("id", "t", "is_text")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256, kept)`` of every row."""
    own = F.col(id_col).cast("long")
    source = docs.select(F.coalesce(own, F.lit(_LAST)).alias("id"), F.xxhash64(text_bytes(text_col)).alias("t"), own.alias("own"), text_bytes(text_col).alias("data"))
    rows = source.select("id", "t", "data").mapInArrow(_parse, _SCHEMA).repartition("k").sortWithinPartitions("k")
    parsed = materialize(rows.mapInArrow(_dictionary, _SCHEMA))
    wanted = _beside_text(source, parsed.where(f"kind in ({ALIGNED}, {WINDOW})"))
    rows = wanted.mapInArrow(_wanted, f"{_SCHEMA}, data binary").repartition("k").sortWithinPartitions("k")
    ranked = materialize(rows.mapInArrow(_ranked, _SCHEMA))
    covered = parsed.where(f"kind = {COVERED}").unionByName(ranked)
    out = _beside_text(source, covered).mapInArrow(_cut, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumnRenamed("id", id_col)
