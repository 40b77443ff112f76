"""Secret scans: an Aho-Corasick keyword prefilter, anchored patterns near its hits, embedded checksums.

Texts are scanned as bytes.  The automaton runs over the lower-cased text; only where a keyword
hits is that kind's pattern matched, anchored at the hit.  Hexadecimal runs have no keyword: their
alphabet is mapped to one letter first, and the run of 24 such letters is the keyword.  Tokens with
an embedded CRC-32 (``ghp_...``, ``npm_...``) count only if it is right.

Null texts count as empty and give no spans; offsets are code points, end exclusive.  Repeated rows
are scanned each for itself, texts of any length whole.  Extra columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.llm._common import arrow_map, text_bytes

# The kinds in their order, the keywords that lead to each, and its pattern from the keyword on.
KINDS = ["assign", "access", "hex", "github", "npm"]
BASE = 3
KEYWORDS = {
    "assign": ["password", "passwd", "secret", "token", "apikey", "api_key"],
    "access": ["akia"],
    "github": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "npm": ["npm_"],
}
PATTERNS = {
    "assign": re.compile(rb"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "github": re.compile(rb"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
    "npm": re.compile(rb"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"),
}
HEX_RUN, ACCESS_LENGTH, ASSIGNED_LENGTH = 24, 20, 6
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_HEX_MAP = bytes(ord("h") if chr(c) in "0123456789abcdef" else ord(" ") for c in range(256))
_AUTOMATON: list = []


def automaton():
    if not _AUTOMATON:
        import ahocorasick

        a = ahocorasick.Automaton()
        for kind, words in KEYWORDS.items():
            for w in words:
                a.add_word(w, (kind, len(w)))
        a.make_automaton()
        _AUTOMATON.append(a)
    return _AUTOMATON[0]


def crc_base62(data: bytes) -> str:
    """CRC-32 as six base-62 digits, the checksum at the end of such tokens."""
    n, out = zlib.crc32(data), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def _valid(kind: str, m: re.Match) -> bool:
    if kind == "assign":
        return len(m[1]) >= ASSIGNED_LENGTH
    if kind == "access":
        return len(m[0]) >= ACCESS_LENGTH
    return crc_base62(m[1]) == m[2].decode()


def scan(data: bytes) -> list[tuple[int, int, int]]:
    """``(start, kind index, end)`` in bytes, sorted."""
    spans = []
    last = dict.fromkeys(KEYWORDS, 0)
    hits = [(end - n + 1, kind) for end, (kind, n) in automaton().iter(data.lower().decode("latin-1"))]
    for start, kind in sorted(hits):
        if start < last[kind] or not (m := PATTERNS[kind].match(data, start)):
            continue
        if kind in ("assign", "access"):  # leftmost, not overlapping: a failing match is passed over, not tried again
            last[kind] = m.end()
        if _valid(kind, m):
            last[kind] = m.end()
            spans.append((start, KINDS.index(kind), m.end()))
    runs = data.translate(_HEX_MAP)
    key, at = b"h" * HEX_RUN, 0
    while (at := runs.find(key, at)) >= 0:
        end = runs.find(b" ", at)
        end = len(runs) if end < 0 else end
        spans.append((at, KINDS.index("hex"), end))
        at = end
    return sorted(spans)


def code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Byte offsets of sorted spans as code points."""
    if not spans or data.isascii():
        return spans
    place, at, n = {}, 0, 0
    for x in sorted({y for s, _, e in spans for y in (s, e)}):
        n += len(data[at:x].decode("utf-8", "replace"))
        place[x], at = n, x
    return [(place[s], k, place[e]) for s, k, e in spans]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_assign, n_access, n_hex, n_checked, base_sha256, spans)`` of every row."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for data in batch.column(1).to_pylist():
            spans = code_points(data, scan(data))
            base = [x for x in spans if x[1] < BASE]
            count = [sum(x[1] == k for x in base) for k in range(BASE)]
            out.append((*count, len(spans) - len(base), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        names = ["id", "n_assign", "n_access", "n_hex", "n_checked", "base_sha256", "spans"]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names)

    schema = "id long, n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string"
    found = arrow_map(docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("data")), one, schema)
    return found.withColumnRenamed("id", id_col)
