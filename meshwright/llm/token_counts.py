"""Edit-aware token counts.

A text is cut into pre-tokens, whose token counts are the leaves of a segment tree (in blocks, with
sums of counts and lengths above).  An edit descends to the blocks it touches, cuts their text
again from a boundary before the edit (with two code points of context, as far as the pattern
looks ahead) until the new boundaries meet old ones, encodes only pre-tokens between, and updates the sums on the
paths above.

Null texts count as empty: no tokens.  Edits beyond the end of a text are put at its end.  Rows that
repeat an id, or have none, are counted each for itself.  Texts are read whole, whatever their length;
extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.llm._common import arrow_map, chunks, text_bytes

#: Pre-tokens of a block, and counts that a worker remembers.
BLOCK, CACHE = 64, 400_000
#: How far a boundary depends on the text after it, in code points.
AHEAD = 2

_CODERS: dict = {}


class Coder:
    """Pre-token pattern and token counts of a rank file."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import base64

        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.find = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        for p in set(pieces):
            if p not in known:
                known[p] = len(self.encoding.encode_ordinary(p))
        return [known[p] for p in pieces]


def coder(ranks_path: str, pattern: str) -> Coder:
    if (ranks_path, pattern) not in _CODERS:
        _CODERS[ranks_path, pattern] = Coder(ranks_path, pattern)
    return _CODERS[ranks_path, pattern]


class TokenTree:
    """Token counts of one text, kept under edits."""

    def __init__(self, text: str, coder: Coder) -> None:
        self.coder, self.text = coder, text
        pieces = coder.find.findall(text)
        counts, lengths = coder.counts(pieces), list(map(len, pieces))
        self.leaves = [(lengths[s : s + BLOCK], counts[s : s + BLOCK]) for s in range(0, max(1, len(pieces)), BLOCK)]
        self.width = 1 << (len(self.leaves) - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), np.int64)  # length and count of every subtree; the root is 1
        for k, (n, c) in enumerate(self.leaves):
            self.sums[self.width + k] = sum(n), sum(c)
        level = self.width
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level].reshape(-1, 2, 2).sum(1)
            level //= 2
        self.pre_tokens, self.encoded, self.updated = len(pieces), 0, 0

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def _block(self, at: int) -> tuple[int, int]:
        """The block that holds a code point, and where it begins."""
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            if at >= begin + self.sums[node, 0] and self.sums[node + 1, 0]:
                begin += int(self.sums[node, 0])
                node += 1
        return node - self.width, begin

    def _set(self, k: int, lengths: list[int], counts: list[int]) -> None:
        self.leaves[k] = (lengths, counts)
        node = self.width + k
        change = np.array((sum(lengths), sum(counts))) - self.sums[node]
        while node:
            self.sums[node] += change
            self.updated += 1
            node //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end]; only pre-tokens touched, and their context, are encoded."""
        start = min(max(start, 0), len(self.text))
        end = min(max(end, start), len(self.text))
        text = self.text[:start] + new + self.text[end:]
        moved = len(new) - (end - start)
        first, begin = self._block(max(0, start - AHEAD))
        lengths, counts = [], []
        while first and begin > start - AHEAD:  # the context begins in an earlier block
            first -= 1
            begin -= int(self.sums[self.width + first, 0])
        at = begin
        for n, c in zip(*self.leaves[first], strict=True):
            if at + n + AHEAD > start:
                break
            lengths.append(n)
            counts.append(c)
            at += n
        fresh: list[str] = []
        # Old boundaries, block by block as they are needed.
        place, reached = begin, first
        boundary: dict[int, tuple[int, int]] = {}

        def load() -> bool:
            nonlocal place, reached
            if reached >= len(self.leaves):
                return False
            for j, n in enumerate(self.leaves[reached][0]):
                boundary[place] = (reached, j)
                place += n
            reached += 1
            return True

        load()
        met = None
        while at < len(text):
            while at - moved >= place and load():
                pass
            if at >= start + len(new) and at - moved >= end and (at - moved) in boundary:
                met = boundary[at - moved]
                break
            m = self.coder.find.match(text, at)
            fresh.append(m[0])
            at = m.end()
        self.encoded += len(fresh)
        lengths += map(len, fresh)
        counts += self.coder.counts(fresh)
        last, skip = met if met else (len(self.leaves) - 1, len(self.leaves[-1][0]))
        tail = self.leaves[last]
        if last == first:
            self._set(first, lengths + tail[0][skip:], counts + tail[1][skip:])
        else:
            self._set(first, lengths, counts)
            for k in range(first + 1, last):
                self._set(k, [], [])
            self._set(last, tail[0][skip:], tail[1][skip:])
        self.text = text


def standard_edits(n: int) -> list[tuple[int, int, str]]:
    """The edits of the query, for a text of n code points: one replaced, one deleted, one inserted, one appended."""
    return [(n // 3, n // 3 + min(20, n // 10), "an edited passage of 2024"), (n // 2, n // 2 + min(12, n // 10), ""), (2 * n // 3, 2 * n // 3, " inserted, with 17 words' worth\n\n of  spaces "), (1 << 60, 1 << 60, " The end.")]


def token_counts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", edits=standard_edits) -> DataFrame:
    """``(id, n_tokens, n_pre_tokens, edited_tokens, encoded_pre_tokens, updated_sums)`` of every row before and after ``edits(n)``."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, rows = coder(ranks_path, pattern), []
        for part in chunks(batch, "data"):
            for data in part.column(1).to_pylist():
                tree = TokenTree(data.decode("utf-8", "replace"), own)
                before = tree.tokens
                for e in edits(len(tree.text)):
                    tree.edit(*e)
                rows.append((before, tree.pre_tokens, tree.tokens, tree.encoded, tree.updated))
        names = ["id", "n_tokens", "n_pre_tokens", "edited_tokens", "encoded_pre_tokens", "updated_sums"]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True))], names)

    schema = "id long, n_tokens long, n_pre_tokens long, edited_tokens long, encoded_pre_tokens long, updated_sums long"
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("data")), one, schema).withColumnRenamed("id", id_col)
