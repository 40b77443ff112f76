"""Best-fit packing by a length histogram.

Documents are tokenized, closed by the id 0 and cut into pieces of at most ``capacity`` ids.  Best
fit decreasing runs over the counts of the (at most ``capacity``) lengths on the driver, never over
documents; its plan is a list of slot ranges.  Pieces take planned slots by their rank within their
length.  Ranks come from counts per (block, length) and row numbers within a block, so a length
that a third of the pieces share is never gathered in one task.

Null and empty texts give one piece of the closing id.  Repeated rows are packed as often as they
occur, rows without an id like any others.  Texts of any length are coded whole; extra columns are not
read.  An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import gc
import json
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.llm._common import arrow_map, chunks, materialize, text_bytes

CAPACITY = 2048
#: Pieces of a block whose ranks one task numbers.
BLOCK_ROWS = 4_000
#: Distinct words of a generation; a worker remembers two.
CACHE_WORDS = 300_000

_CODERS: dict = {}


class WordCoder:
    """Ids of whole texts by a tokenizer that never joins text across ASCII white space, word by word with a cache.

    For a tokenizer that lower-cases and parts letters from other signs, a word of letters and its
    trailing punctuation are coded apart, if the tokenizer itself codes the two signs at the cut apart
    (it does not behind letters that it normalises to end with a mark).  New words are coded together
    in one text, parted by a sign that is a single id.

    A full cache becomes the older generation.  Words of it that occur again move to the new one, so
    that rare words fall out and frequent ones are coded once.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}
        self.older: tuple[dict[bytes, bytes], dict[bytes, bytes]] = {}, {}
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.mark = next(m for m in "^~`\\|" if len(ids(m)) == 1)
        self.mark_id = ids(self.mark)[0]
        self.parts = ids("Ab,.") == ids("ab") + ids(",.")
        self.ids, self.apart = ids, {}
        self.ends = self._ends()

    def _cuts(self, last: str, first: str) -> bool:
        """Whether the tokenizer cuts between a letter and the sign behind it."""
        if (last, first) not in self.apart:
            self.apart[last, first] = self.ids(last + first) == self.ids(last) + self.ids(first)
        return self.apart[last, first]

    def _ends(self) -> np.ndarray | None:
        """Which ids end a pre-token, if the tokenizer marks each one's end by a suffix."""
        from tokenizers.pre_tokenizers import ByteLevel

        model = json.loads(self.tokenizer.to_str())["model"]
        suffix = model.get("end_of_word_suffix")
        if not suffix or any(c + suffix not in model["vocab"] for c in ByteLevel.alphabet()):
            return None
        ends = np.zeros(max(model["vocab"].values()) + 1, bool)
        ends[[i for word, i in model["vocab"].items() if word.endswith(suffix)]] = True
        return ends

    def _together(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _keep(self, words: list[bytes], ids: np.ndarray, starts: list[int], ends: list[int]) -> None:
        raw = ids.tobytes()
        for word, s, e in zip(words, starts, ends, strict=True):
            self.stems[word] = raw[4 * s : 4 * e]

    def _code(self, words: list[bytes]) -> None:
        """Learn ``words`` as they stand."""
        texts = [w.decode("utf-8", "replace") for w in words]
        left = range(len(words))
        if self.ends is not None:
            # A word of letters is one pre-token at least, so where there are as many ends as words, each is one.
            letters = [k for k, text in enumerate(texts) if text.isalpha()]
            ids = self._together(" ".join([texts[k] for k in letters]))
            cut = np.flatnonzero((ids < len(self.ends)) & self.ends[np.minimum(ids, len(self.ends) - 1)]) + 1
            if letters and len(cut) == len(letters):
                self._keep([words[k] for k in letters], ids, [0, *cut[:-1].tolist()], cut.tolist())
                left = sorted(set(left).difference(letters))
        plain = [k for k in left if self.mark not in texts[k]]
        ids = self._together(f" {self.mark} ".join([texts[k] for k in plain]))
        cut = np.flatnonzero(ids == self.mark_id)
        if plain and len(cut) == len(plain) - 1:
            self._keep([words[k] for k in plain], ids, [0, *(cut + 1).tolist()], [*cut.tolist(), len(ids)])
            left = sorted(set(left).difference(plain))
        for k in left:
            self.stems[words[k]] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[bytes]) -> None:
        whole, split = [], []
        for w in words:
            # Letters before a mark are composed in their own case (W with a ring is two signs, w with one is one).
            low = w.lower() if self.parts and w.isascii() else w
            stem = low.rstrip(b",.!?;:|*$%&#") if self.parts else low
            if 0 < len(stem) < len(low):
                letters = stem.decode("utf-8", "replace")
                if letters.isalpha() and self._cuts(letters[-1], chr(low[len(stem)])):
                    split.append((w, stem, low[len(stem) :]))
                    continue
            whole.append((w, low))
        stems, older = self.stems, self.older[1]
        need = []
        for x in {low for _, low in whole}.union(*(both for _, *both in split)).difference(stems):
            if x in older:
                stems[x] = older[x]
            else:
                need.append(x)
        for s in range(0, len(need), 4000):
            self._code(need[s : s + 4000])
        for w, low in whole:
            self.known[w] = stems[low]
        for w, stem, tail in split:
            self.known[w] = stems[stem] + stems[tail]

    def encode_batch(self, texts: pa.Array | list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each UTF-8 text."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.binary())
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {}, (self.known, self.older[1])
        if len(self.stems) > CACHE_WORDS:
            self.stems, self.older = {}, (self.older[0], self.stems)
        # Words are parted, told apart and put back by Arrow, so that Python sees each one of a batch once.
        parts = pc.ascii_split_whitespace(texts.view(pa.string()))
        told = parts.flatten().dictionary_encode()
        words = told.dictionary.view(pa.binary()).to_pylist()
        collecting = gc.isenabled()
        gc.disable()  # many lists and tuples, none in a cycle
        try:
            known, older = self.known, self.older[0]
            new = []
            for w in words:
                if w not in known:
                    if w in older:
                        known[w] = older[w]
                    else:
                        new.append(w)
            if new:
                self._learn(new)
            ids = pa.array([known[w] for w in words], pa.large_binary()).take(told.indices)
        finally:
            if collecting:
                gc.enable()
        at = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
        ends = at[np.asarray(parts.offsets) - parts.offsets[0].as_py()].tolist() if len(ids) else [0] * (len(parts) + 1)
        data = memoryview(ids.buffers()[2] or b"")
        return [bytes(data[s:e]) for s, e in zip(ends, ends[1:], strict=False)]


def coder(path: str) -> WordCoder:
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``(id, piece, start, length, ids_crc32[, ids])`` of every row's pieces."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        width = 4 * capacity
        for part in chunks(batch, "data"):
            for i, ids in zip(part.column(0).to_pylist(), coder(tokenizer_path).encode_batch(part.column(1)), strict=True):
                ids += b"\0\0\0\0"
                for k, s in enumerate(range(0, len(ids), width)):
                    cut = ids[s : s + width]
                    rows.append((i, k, s // 4, len(cut) // 4, zlib.crc32(cut), *((cut,) if with_ids else ())))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]
        names = ["id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("data")), one, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best fit decreasing over a histogram.

    Returns slot ranges ``(length, first rank, first sequence, offset)``, in order of rank within
    each length, and the number of sequences.  A range ends where the next of its length begins.
    """
    groups: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs of sequences (first, count)
    rooms: list[int] = []
    slots, opened = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        changed: list[tuple[int, int, int]] = []
        while left:
            k = bisect.bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[k]
                take = min(n, left)
                if take < n:
                    if room not in groups:
                        bisect.insort(rooms, room)
                    groups[room].append((first + take, n - take))
                fits = 1
            else:
                room, first = capacity, opened
                fits = min(capacity // length, left)
                take = left // fits
                opened += take
            for j in range(fits):
                slots.append((length, rank, first, capacity - room + j * length))
                rank += take
                left -= take
            changed.append((room - fits * length, first, take))
            # Room that still fits this length is offered again at once.
            for room, first, n in changed:
                if room:
                    if room not in groups:
                        bisect.insort(rooms, room)
                    groups[room].append((first, n))
            changed.clear()
    return slots, opened


def pack(piece_rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``(id, piece, length, ..)`` rows; offsets are gapless from 0."""
    rows = materialize(piece_rows)
    total = rows.count()
    blocks = max(1, -(-total // BLOCK_ROWS))
    # The checkpoint fixes the rows' order, so that their numbers deal them out alike whenever they are read.
    rows = rows.withColumn("_n", F.monotonically_increasing_id()).withColumn("_block", F.pmod(F.xxhash64("_n"), F.lit(blocks)))
    counted = materialize(rows.groupBy("_block", "length").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("_block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    histogram = {int(r["length"]): int(r["n"]) for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    slots, _ = plan(histogram, capacity)
    within = Window.partitionBy("_block", "length").orderBy("_n")
    ranked = rows.withColumn("_row", F.row_number().over(within)).join(offsets, ["_block", "length"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_row") - 1).drop("_block", "_before", "_row", "_n")

    by_length: dict[int, tuple] = {}
    table = np.array(slots, np.int64).reshape(-1, 4)
    for length in histogram:
        mine = table[table[:, 0] == length]
        by_length[length] = (mine[:, 1], mine[:, 2], mine[:, 3])
    others = [c for c in ranked.columns if c != "_rank"]

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        rank, length = batch.column("_rank").to_numpy(), batch.column("length").to_numpy()
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            first_rank, first, place_at = by_length[int(n)]
            k = np.searchsorted(first_rank, rank[at], "right") - 1
            sequence[at], offset[at] = first[k] + rank[at] - first_rank[k], place_at[k]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(sequence), pa.array(offset)], [*others, "sequence_id", "offset"])

    kinds = dict(ranked.dtypes)
    return arrow_map(ranked, place, ", ".join(f"{c} {kinds[c]}" for c in others) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack ``docs``."""
    packed = pack(pieces(docs, tokenizer_path, id_col, text_col, capacity, with_ids), capacity)
    return packed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))
