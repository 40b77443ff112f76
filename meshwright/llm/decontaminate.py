"""Benchmark decontamination by template canonicalisation.

Texts become tokens (runs of letters and digits, lower-cased); numbers, units and names (words with a
capital) become typed placeholders.  Windows of ``WINDOW`` template tokens are hashed and joined with
those of the benchmark.  Windows that match along one alignment are checked slot by slot: a value of
the item must stand for one value of the document, so that a question with other numbers or names is
caught and a mere likeness of form is not.  Where it stands for several, the most frequent counts, at
a tie the item's own or else none, and windows that hold another are dropped; so are windows with
fewer than ``LITERAL`` words besides slots, unless all their slots hold the item's own values.

A document is contaminated by an item of which at least ``COVERAGE`` of the windows match with
consistent slots, or windows that hold ``COVERED`` of the tokens, or a passage of windows in a row
with ``PASSAGE`` tokens besides slots of other values.  Items of one template share its windows; each
is checked by the values in its own slots and reported for itself.  Items with fewer than ``WINDOW``
tokens are matched whole; those under ``SHORT`` tokens word for word, where they stand alone as a
sentence or line.  Items without tokens, empty or null ones match nothing.

Documents are scanned once.  A bitmap of the benchmark's window hashes, of at most ``FILTER_BITS`` bits
whatever the benchmark's size, lets a document's windows pass that may be among them; these are
joined with the benchmark's windows by hash, then gathered by document and template, and joined with
the items of the template.  Both joins are salted, so that a passage that many documents share is not
one task's work.

Null texts count as empty.  Rows that repeat an id and a text are reported once each; rows that share
an id only, or have none, each by their own text.  Very long texts are scanned in one piece, others some
``TOKEN_BYTES`` together.  Extra columns are not read; an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.llm._common import arrow_map, chunks, free_name, materialize, text_bytes
from meshwright.llm._rolling import powers, prefix, scramble, stretches

WINDOW, SHORT, COVERAGE, LITERAL = 8, 5, 0.5, 2
COVERED, PASSAGE = 0.75, 20
#: Bits of the filter at least and at most, and bits for each window of the benchmark between those.
FILTER_LEAST, FILTER_BITS, BITS_EACH = 20, 28, 10
#: Parts that the rows of a hot window or template are dealt to.
SALT = 16
#: Contaminated rows whose keys are broadcast at most; more of them are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Bytes of text whose tokens are held at once: some sixty bytes of arrays for each.
TOKEN_BYTES = 1 << 20
# Words that are numbers, and units of measure.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
UNITS = "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons ounce ounces pound pounds lb ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours day days week weeks month months year years cent cents dollar dollars usd euro euros eur percent degree degrees mph kmh volt volts watt watts hertz joule joules newton newtons".split()

_NUMBER, _UNIT, _NAME = (np.uint64(x) for x in (0xA5A5A5A500000001, 0xA5A5A5A500000002, 0xA5A5A5A500000003))
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_KIND = np.array([2 if 48 <= c <= 57 else 1 if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8)

_STOP = np.array([c in b".!?\n\r:;" for c in range(256)], np.int64)


def _hash_words(words: list[str]) -> np.ndarray:
    out = []
    for w in words:
        b = np.frombuffer(w.encode(), np.uint8)
        out.append(stretches(prefix(b), np.array([0]), np.array([len(b)]))[0])
    return np.sort(np.array(out, np.uint64))


_TABLES: list[np.ndarray] = []


def _among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(h), bool)
    at = np.searchsorted(table, h)
    at[at == len(table)] = 0
    return table[at] == h


class Tokens:
    """Template tokens of many texts laid end to end."""

    def __init__(self, texts: list[bytes]) -> None:
        if not _TABLES:
            _TABLES.extend((_hash_words(NUMBER_WORDS), _hash_words(UNITS)))
        self.data = b"\n" + b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.data, np.uint8)
        kind = _KIND[raw]
        inner = ((raw[1:-1] == 46) | (raw[1:-1] == 44)) & (kind[:-2] == 2) & (kind[2:] == 2)
        kind[1:-1][inner] = 2  # a point or comma between digits
        word = kind > 0
        edge = np.diff(word.astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        sums = prefix(_LOWER[raw])
        h = stretches(sums, self.start, self.end)
        digits = np.concatenate(([0], np.cumsum(kind == 2)))
        number = (digits[self.end] - digits[self.start] == self.end - self.start) | _among(h, _TABLES[0])
        unit = _among(h, _TABLES[1])
        first = raw[self.start]
        capital = ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (raw[np.minimum(self.start + 1, len(raw) - 1)] <= 0x9E))
        self.slot = number | unit | capital
        self.code = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(capital, _NAME, h)))
        self.raw = raw
        ends = np.cumsum([0] + [len(t) + 1 for t in texts])
        self.bound = np.searchsorted(self.start, ends + 1)  # tokens of text k are bound[k]:bound[k+1]

    def windows(self, size: int) -> np.ndarray:
        """Hashes of the windows from each token on (across texts too; see ``inside``)."""
        n = len(self.code) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        weight = powers(0xC2B2AE3D27D4EB4F, size)
        with np.errstate(over="ignore"):
            spread = scramble(self.code)
            total = spread[:n].copy()
            for k in range(1, size):
                total += spread[k : n + k] * weight[k]
            return scramble(total + np.uint64(size))

    def value(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].lower()

    def stand_alone(self, first: np.ndarray, size: int) -> np.ndarray:
        """Which stretches of ``size`` tokens begin and end a sentence or line."""
        ends = np.concatenate(([0], np.cumsum(_STOP[self.raw])))
        gap = ends[np.append(self.start, len(self.raw))] - ends[np.concatenate(([0], self.end))]  # stops before each token, and after the last
        return (gap[first] > 0) & (gap[first + size] > 0)


def item_rows(items: list[tuple[int, bytes]]) -> tuple[list[tuple], list[tuple]]:
    """Per item ``(template, item, size of a window, windows, places of slots, their values)``; per template its windows ``(size, hash, template, place)``."""
    tokens = Tokens([x for _, x in items])
    hashes = {n: tokens.windows(n) for n in range(1, WINDOW + 1)}
    found, windows = [], []
    seen: set[int] = set()
    for k, (item, _) in enumerate(items):
        s, e = int(tokens.bound[k]), int(tokens.bound[k + 1])
        if s == e:
            continue
        n = min(WINDOW, e - s)
        template = xxhash.xxh3_64_intdigest(tokens.code[s:e].tobytes()) - (1 << 63)
        slots = [j - s for j in range(s, e) if tokens.slot[j]]
        found.append((template, item, n, e - s - n + 1, slots, [tokens.value(s + j) for j in slots]))
        if template not in seen:
            seen.add(template)
            windows += [(n, int(hashes[n][j].view("<i8")), template, j - s) for j in range(s, e - n + 1)]
    return found, windows


def may_hold(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes a bitmap may hold; its number of bits is a power of two."""
    at = h & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap_of(h: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(1 << bits, bool)
    out[(h & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little")


def window_hits(texts: list[bytes], sizes: list[int], bitmap: np.ndarray) -> Iterator[tuple[int, int, int, int, list[bytes]]]:
    """``(text, size, hash, place in the text, values of the slots)`` of the windows that the bitmap may hold."""
    tokens = Tokens(texts)
    for n in sizes:
        h = tokens.windows(n)
        at = np.flatnonzero(may_hold(bitmap, h))
        text = np.searchsorted(tokens.bound, at, "right") - 1
        inside = at + n <= tokens.bound[text + 1]
        if n < SHORT and len(at):
            inside &= tokens.stand_alone(at, n)
        for j, t in zip(at[inside].tolist(), text[inside].tolist(), strict=True):
            yield t, n, int(h[j].view("<i8")), j - int(tokens.bound[t]), [tokens.value(k) for k in range(j, j + n) if tokens.slot[k]]


def _doubts(values: list[bytes], other: dict[int, bytes]) -> list[int]:
    """Slots that hold another value than the one that counts for theirs."""
    classes: dict[bytes, list[int]] = defaultdict(list)
    for k in other:
        classes[values[k]].append(k)
    out = []
    for own, slots in classes.items():
        counts = Counter(other[k] for k in slots)
        best = [v for v, n in counts.items() if n == max(counts.values())]
        right = best[0] if len(best) == 1 else own if own in best else None
        out += [k for k in slots if other[k] != right]
    return out


def _passage(at: list[int], size: int, changed: list[int]) -> int:
    """Tokens of the longest passage of windows in a row, without the places that ``changed``."""
    best, start = 0, None
    for k, a in enumerate(at):
        start = a if k == 0 or a != at[k - 1] + 1 else start
        end = a + size
        best = max(best, end - start - sum(start <= p < end for p in changed)) if end - start >= PASSAGE else best
    return best


def judge(size: int, windows: int, slots: list[int], values: list[bytes], hits: list[tuple[int, int, list[bytes]]]) -> tuple[int, bool] | None:
    """Windows matched, and whether all slots hold the item's values, by the hits ``(shift, place, values)`` of one text; None if it is not contaminated."""
    aligned: dict[int, dict[int, list[bytes]]] = defaultdict(dict)
    for shift, at, held in hits:
        aligned[shift][at] = held
    own = {at: [k for k, p in enumerate(slots) if at <= p < at + size] for at in {a for _, a, _ in hits}}
    there: set[int] = set()
    changed_at, passage = False, False
    for found in aligned.values():
        other: dict[int, bytes] = {}
        for at, held in found.items():
            other.update(zip(own[at], held, strict=True))
        wrong = set(_doubts(values, other))
        changed = {k for k, v in other.items() if v != values[k]}
        kept = []
        for at in sorted(found):
            bare = size < SHORT or size - len(own[at]) < LITERAL
            if wrong.isdisjoint(own[at]) and not (bare and changed.intersection(own[at])):
                kept.append(at)
        there.update(kept)
        changed_at |= bool(kept and changed)
        passage |= _passage(kept, size, [slots[k] for k in changed]) >= PASSAGE
    if not there:
        return None
    order = sorted(there)
    covered = sum(min(size, b - a) for a, b in zip(order, order[1:], strict=False)) + size
    if passage or len(order) >= COVERAGE * windows or covered >= COVERED * (windows + size - 1):
        return len(order), not changed_at
    return None


class Index:
    """A benchmark of few items, in memory: the same steps without Spark."""

    def __init__(self, items: list[tuple[int, bytes]]) -> None:
        found, windows = item_rows(sorted(items))
        self.items: dict[int, list[tuple]] = defaultdict(list)
        for template, *item in found:
            self.items[template].append(item)
        self.windows: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for n, h, *place in windows:
            self.windows[n, h].append(place)
        self.sizes = sorted({n for n, _ in self.windows})
        self.bitmap = bitmap_of(np.array([h for _, h in self.windows], np.int64).view(np.uint64), FILTER_LEAST)

    def matches(self, texts: list[bytes]) -> list[tuple[int, int, int, int, bool]]:
        """``(text, item id, windows matched, windows, slots equal)`` of the contaminated texts."""
        got: dict[tuple[int, int], list[tuple]] = defaultdict(list)
        for t, n, h, j, held in window_hits(texts, self.sizes, self.bitmap):
            for template, at in self.windows.get((n, h), ()):
                got[t, template].append((j - at, at, held))
        out = []
        for (t, template), hits in got.items():
            for item, size, windows, slots, values in self.items[template]:
                if verdict := judge(size, windows, slots, values, hits):
                    out.append((t, item, verdict[0], windows, verdict[1]))
        return sorted(out)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def benchmark_tables(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The items and the windows of their templates (see ``item_rows``)."""
    texts = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("id"), text_bytes(text_col).alias("data"))

    def some(pick: int, kinds: list[pa.DataType], names: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in chunks(batch, "data", TOKEN_BYTES):
                    yield _batch(item_rows(list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)))[pick], kinds, names)

        return run

    long, small = pa.int64(), pa.int32()
    items = texts.mapInArrow(some(0, [long, long, small, long, pa.list_(small), pa.list_(pa.binary())], ["template", "item", "size", "windows", "slots", "own"]), "template long, item long, size int, windows long, slots array<int>, own array<binary>")
    windows = texts.mapInArrow(some(1, [small, long, long, long], ["size", "h", "template", "place"]), "size int, h long, template long, place long")
    return materialize(items), materialize(windows.distinct())


def _filter(windows: DataFrame) -> tuple[list[int], np.ndarray]:
    """Sizes of the benchmark's windows, and the bitmap of their hashes, put together from one for each of a few tasks."""
    counts = {r["size"]: r["n"] for r in windows.groupBy("size").agg(F.count("*").alias("n")).collect()}  # WINDOW rows at most
    bits = min(FILTER_BITS, max(FILTER_LEAST, (sum(counts.values()) << BITS_EACH).bit_length()))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 << bits >> 3, np.uint8)
        for batch in batches:
            out |= bitmap_of(batch.column(0).to_numpy().view(np.uint64), bits)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["bitmap"])

    bitmap = np.zeros(1 << bits >> 3, np.uint8)
    for r in windows.select("h").coalesce(8).mapInArrow(one, "bitmap binary").toLocalIterator():
        bitmap |= np.frombuffer(r["bitmap"], np.uint8)
    return sorted(counts), bitmap


def _found(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str) -> DataFrame:
    """``(id, t, item, matched, windows, same, copies)``: contaminated texts by id and digest, and how many rows repeat them."""
    items, windows = benchmark_tables(benchmark, item_col, "text")
    sizes, bitmap = _filter(windows)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # 1 << FILTER_BITS bits at most
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_bytes(text_col)).alias("t"), text_bytes(text_col).alias("data"))
    long, small = pa.int64(), pa.int32()

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        for part in chunks(batch, "data", TOKEN_BYTES):
            keys = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
            rows += [(*keys[t], *hit) for t, *hit in window_hits(part.column(2).to_pylist(), sizes, shared.value)]
        return _batch(rows, [long, long, small, long, long, pa.list_(pa.binary())], ["id", "t", "size", "h", "j", "held"]) if rows else None

    salt = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    hits = arrow_map(source, scan, "id long, t long, size int, h long, j long, held array<binary>").withColumn("salt", F.pmod(F.xxhash64("id", "t"), F.lit(SALT)).cast("int"))
    hits = hits.join(windows.withColumn("salt", salt), ["size", "h", "salt"]).select("id", "t", "template", "salt", F.struct((F.col("j") - F.col("place")).alias("shift"), "place", "held").alias("hit"))
    # A text's windows of one template: as many as it is long.
    gathered = hits.groupBy("id", "t", "template", "salt").agg(F.collect_list("hit").alias("hits"))
    both = gathered.join(items.withColumn("salt", salt), ["template", "salt"])

    def decide(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        for i, t, item, size, n, slots, own, hits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            single = {(h["shift"], h["place"]): h["held"] for h in hits}
            if verdict := judge(size, n, slots, own, [(*place, held) for place, held in single.items()]):
                rows.append((i, t, item, verdict[0], n, verdict[1], len(hits) // len(single)))
        return _batch(rows, [long, long, long, long, long, pa.bool_(), long], ["id", "t", "item", "matched", "windows", "same", "copies"]) if rows else None

    return arrow_map(both.select("id", "t", "item", "size", "windows", "slots", "own", "hits"), decide, "id long, t long, item long, matched long, windows long, same boolean, copies long")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``(id, item, windows, item_windows, coverage, slots_equal)`` of every contaminated row and item."""
    found = _found(docs, benchmark, id_col, text_col, item_col).withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("matched").alias("windows"), F.col("windows").alias("item_windows"), (F.col("matched") / F.col("windows")).alias("coverage"), F.col("same").alias("slots_equal"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` that no item contaminates, as they are."""
    leaks = materialize(_found(docs, benchmark, id_col, text_col, item_col).select("id", "t").distinct())
    mine = free_name(docs, "_digest")
    own = docs.withColumn(mine, F.xxhash64(text_bytes(text_col)))
    small = leaks.count() <= BROADCAST_ROWS
    keys = F.col(mine).eqNullSafe(F.col("t")) & F.col(f"_docs.{id_col}").cast("long").eqNullSafe(F.col("_leaks.id"))
    return own.alias("_docs").join((F.broadcast(leaks) if small else leaks).alias("_leaks"), keys, "left_anti").drop(mine)
