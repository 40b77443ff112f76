"""SimHash near-duplicate detection with deletion-variant signatures.

A 64-bit fingerprint is cut into ``ceil((radius + 1) / 2)`` segments, so that of two fingerprints
within ``radius`` bits one segment differs by at most one bit.  Each segment is indexed once for
each of its bits with that bit wiped (its one-wildcard variants); equal variants meet in a bucket,
where Hamming distances are verified.  A bucket emits a spanning forest of its links, not its
pairs.  Buckets beyond ``BLOCK`` members are dealt out again as pairs of blocks, so that no task
holds an unbounded bucket and no link is lost.

Null texts count as empty; a text without words has fingerprint 0.  Repeated rows and equal
fingerprints fall into one class before indexing.  Rows without an id take part in nothing and get
a null component unless another row of their class has an id.  Very long texts are hashed a stretch of
shingles at a time; extra columns are not read (the pipeline's stage keeps them).  An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.llm._common import arrow_map, chunks, free_name, materialize, text_bytes, text_digest
from meshwright.operators.components import connected_components, forests

#: Members of a bucket that one task compares among themselves.
BLOCK = 16_384
#: Text of a group that one task compares exactly among itself at most; larger groups are dealt out as pairs of blocks.
#: Groups beyond PART_BYTES are dealt to a few blocks (PARTS) before that, so that one group is not one task's work.
GROUP_BYTES, PART_BYTES, PARTS = 16 << 20, 1 << 18, 16
#: Shingles whose bits are unpacked at once.
_STEP = 1 << 15


def shingle_hashes(data: bytes, ngram: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the word shingles of a text in order, repeats included; A-Z lower-cased, ASCII white space splits."""
    words = data.lower().split()
    if not words:
        return np.empty(0, "<u8")
    text = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= ngram:
        return np.array([digest(text, seed)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = len(words) - ngram + 1
    return np.array([digest(text[s:e], seed) for s, e in zip(starts[:last].tolist(), ends[ngram - 1 :].tolist(), strict=True)], "<u8")


def mix(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash derived from 64-bit hashes; k = 0 leaves them alone."""
    if not k:
        return h
    with np.errstate(over="ignore"):
        z = h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def simhash(hashes: np.ndarray) -> int:
    """64-bit fingerprint: a bit is 1 if it is set in over half of the hashes."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for s in range(0, n, _STEP):
        part = np.ascontiguousarray(hashes[s : s + _STEP])
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3) -> DataFrame:
    """``(id, w0)``: the SimHash of each row's whole text as a signed long."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [simhash(shingle_hashes(t, ngram)) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(out, "<u8").view("<i8"))], ["id", "w0"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("data")), one, "id long, w0 long")


def deletion_variants(word: Column, radius: int, bits: int = 64) -> Column:
    """Array of index keys: every segment with each of its bits wiped in turn."""
    segments = (radius + 2) // 2
    keys = []
    for s in range(segments):
        low, high = s * bits // segments, (s + 1) * bits // segments
        mask = (1 << (high - low)) - 1
        value = F.shiftrightunsigned(word, low).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1))
        keys += [F.xxhash64(F.lit(s), F.lit(b), value.bitwiseAND(F.lit(~(1 << b) if b < 63 else (1 << 63) - 1))) for b in range(high - low)]
    return F.array(*keys)


def _forest(words: np.ndarray, nodes: np.ndarray, radius: int, left: np.ndarray | None = None) -> tuple[list, list]:
    """Spanning forest of the links within one bucket (one vector step per member)."""
    a, b = [], []
    rest = np.arange(len(nodes))
    while len(rest):
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            i = stack.pop()
            near = np.bitwise_count(words[rest] ^ words[i]).sum(axis=1, dtype=np.int64) <= radius
            if near.any():
                found = rest[near]
                a += [nodes[i]] * len(found)
                b += nodes[found].tolist()
                stack += found.tolist()
                rest = rest[~near]
    return a, b


def _bucket_pass(width: int, radius: int, limit: int | None):
    """Streams rows sorted by bucket; emits links, and the members of buckets beyond ``limit`` as they are."""
    names = ["hot", "a", "b", *(f"w{k}" for k in range(width))]

    def emit(hot: bool, a, b, words=None) -> pa.RecordBatch:
        n = len(a)
        cols = [pa.array(np.full(n, hot)), pa.array(np.asarray(a, "<i8")), pa.array(np.asarray(b, "<i8"))]
        cols += [pa.array(np.ascontiguousarray(words[:, k]).view("<i8")) if words is not None else pa.nulls(n, pa.int64()) for k in range(width)]
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes = np.empty(0, "<i8"), np.empty(0, "<i8")
        words = np.empty((0, width), "<u8")
        hot = None

        def settle(keys, nodes, words):
            """Links of whole buckets."""
            cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
            sizes = np.diff(cut)
            two = cut[:-1][sizes == 2]
            close = np.bitwise_count(words[two] ^ words[two + 1]).sum(axis=1, dtype=np.int64) <= radius
            a, b = nodes[two[close]].tolist(), nodes[two[close] + 1].tolist()
            for s, n in zip(cut[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                x, y = _forest(words[s : s + n], nodes[s : s + n], radius)
                a += x
                b += y
            return a, b

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate((keys, batch.column(0).to_numpy(zero_copy_only=False)))
            nodes = np.concatenate((nodes, batch.column(1).to_numpy(zero_copy_only=False)))
            words = np.concatenate((words, np.stack([batch.column(2 + k).to_numpy(zero_copy_only=False).view("<u8") for k in range(width)], axis=1)))
            last = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if hot is not None:
                n = int((keys == hot).sum())
                if n:
                    yield emit(True, nodes[:n], keys[:n], words[:n])
                keys, nodes, words, last = keys[n:], nodes[n:], words[n:], max(0, last - n)
                if not len(keys):
                    continue
                hot = None
            if last:
                a, b = settle(keys[:last], nodes[:last], words[:last])
                if a:
                    yield emit(False, a, b)
                keys, nodes, words = keys[last:], nodes[last:], words[last:]
            if limit and len(keys) > limit:
                hot = keys[0]
                yield emit(True, nodes, keys, words)
                keys, nodes, words = keys[:0], nodes[:0], words[:0]
        if len(keys):
            a, b = settle(keys, nodes, words)
            if a:
                yield emit(False, a, b)

    schema = "hot boolean, a long, b long, " + ", ".join(f"w{k} long" for k in range(width))
    return run, schema


def bucket_links(index: DataFrame, width: int, radius: int) -> DataFrame:
    """Links ``(a, b)`` between nodes that share a key of ``index (key, node, w0..)`` and differ by ``radius`` bits at most."""
    run, schema = _bucket_pass(width, radius, BLOCK)
    words = [f"w{k}" for k in range(width)]
    found = materialize(index.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema))
    links = found.where("not hot").select("a", "b")
    hot = found.where("hot").select(F.col("b").alias("key"), F.col("a").alias("node"), *words)
    if hot.isEmpty():
        return links.distinct()
    blocks = hot.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK // 2)).alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks"))
    dealt = hot.join(blocks, "key").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"), "node", *words)
    again, schema = _bucket_pass(width, radius, None)
    more = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(again, schema).select("a", "b")
    return links.unionByName(more).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 3, radius: int = 3) -> DataFrame:
    """``(id, fingerprint, component_id)`` of every row: fingerprints within ``radius`` bits are linked."""
    prints = materialize(fingerprints(docs, id_col, text_col, ngram))
    classes = materialize(prints.groupBy("w0").agg(F.min("id").alias("node")))
    index = classes.where("node is not null").select(F.explode(deletion_variants(F.col("w0"), radius)).alias("key"), "node", "w0")
    component = connected_components(bucket_links(index, 1, radius))
    named = classes.join(component, "node", "left").select("w0", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "w0").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, t0, t1, data)``: every row's text with its digest."""
    t0, t1 = text_digest(text_col)
    return docs.select(F.col(id_col).cast("long").alias("id"), t0.alias("t0"), t1.alias("t1"), text_bytes(text_col).alias("data"))


def sampled_signatures(texts: DataFrame, ngram: int, tables: int, sample: int, width: int) -> DataFrame:
    """``(id, t0, t1, bytes, w0.., keys)`` of ``texts (id, t0, t1, data)``: a text's length, the wide fingerprint of its set of shingles and, per table, the SimHash of its ``sample`` least shingles."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        for part in chunks(batch, "data"):
            texts = part.column(3).to_pylist()
            words, keys = np.empty((len(texts), width), "<u8"), np.empty((len(texts), tables), "<u8")
            for r, t in enumerate(texts):
                unique = np.unique(shingle_hashes(t, ngram))
                for k in range(width):
                    words[r, k] = simhash(mix(unique, k))
                for k in range(tables):
                    m = mix(unique, 101 + k)
                    if len(m) > sample:
                        m = np.partition(m, sample - 1)[:sample]
                    keys[r, k] = simhash(mix(m, 1)) ^ (k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            flat = pa.array(keys.view("<i8").reshape(-1))
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype="<i4") * tables), flat)
            cols = [*(part.column(c) for c in range(3)), pa.array([len(t) for t in texts], pa.int64()), *(pa.array(np.ascontiguousarray(words[:, k]).view("<i8")) for k in range(width)), listed]
            parts.append(pa.RecordBatch.from_arrays(cols, ["id", "t0", "t1", "bytes", *(f"w{k}" for k in range(width)), "keys"]))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    schema = "id long, t0 long, t1 long, bytes long, " + ", ".join(f"w{k} long" for k in range(width)) + ", keys array<bigint>"
    return arrow_map(texts.select("id", "t0", "t1", "data"), one, schema)


def bits_apart(similarity: float, width: int, deviations: float = 4.0) -> int:
    """Hamming distance of ``width`` x 64-bit fingerprints expected at a Jaccard similarity, and some deviations more."""
    cosine = 2 * similarity / (1 + similarity)
    share = np.arccos(cosine) / np.pi
    n = 64 * width
    return int(n * share + deviations * np.sqrt(n * share * (1 - share)))


def exact_forest(sets: list[np.ndarray], nodes: list[int], similarity: float) -> tuple[list[int], list[int]]:
    """Spanning forest of the pairs of shingle sets whose Jaccard similarity is ``similarity`` or more; empty sets are alike."""
    a, b = [], []
    sets = [s if len(s) else np.zeros(1, "<u8") for s in sets]
    size = np.array([len(s) for s in sets])
    codes = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(size)[:-1])
    mark = np.zeros(1 + max(int(c.max()) for c in codes), bool)
    rest = np.arange(len(nodes))
    flat = None
    while len(rest):
        stack, rest, flat = [rest[0]], rest[1:], None
        while stack and len(rest):
            i = stack.pop()
            if flat is None:
                flat, starts = np.concatenate([codes[k] for k in rest]), np.concatenate(([0], np.cumsum(size[rest])[:-1]))
            mark[codes[i]] = True
            both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[codes[i]] = False
            near = both >= similarity * (size[i] + size[rest] - both) - 1e-9
            if near.any():
                found = rest[near]
                a += [nodes[i]] * len(found)
                b += [nodes[k] for k in found]
                stack += found.tolist()
                rest, flat = rest[~near], None
    return a, b


def exact_links(texts: DataFrame, ngram: int, similarity: float) -> DataFrame:
    """What ties the texts of each key of ``texts (key, node, data)`` whose Jaccard similarity is ``similarity`` or more: ``(a, b)``, a forest of each task."""

    def settle(members: dict[int, np.ndarray]) -> pa.RecordBatch | None:
        a, b = exact_forest(list(members.values()), list(members), similarity) if len(members) > 1 else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]) if a else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, {}
        for batch in batches:
            keys, nodes = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            for r, text in enumerate(batch.column(2)):
                if keys[r] != key:
                    if (out := settle(members)) is not None:
                        yield out
                    key, members = keys[r], {}
                if int(nodes[r]) not in members:  # repeated rows
                    members[int(nodes[r])] = np.unique(shingle_hashes(text.as_py(), ngram))
        if (out := settle(members)) is not None:
            yield out

    return texts.select("key", "node", "data").repartition("key").sortWithinPartitions("key", "node").mapInArrow(lambda batches: forests(run(batches)), "a long, b long")


def text_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = 5, similarity: float = 0.8, tables: int = 10, sample: int = 4, width: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rows with an id as ``(id, t0, t1)``, and their texts as ``(t0, t1, id, root)``, id the least one: texts of Jaccard similarity ``similarity`` or more are linked and share a root.

    At a similarity of 0.8 whole-text fingerprints differ by some ten bits of 64, beyond the reach of
    wildcard segments.  The index here holds SimHashes of samples (per table the few least shingles),
    which are equal with probability s^sample, and passes candidates by a loose limit on a fingerprint of
    ``64 * width`` bits.  Texts that candidates connect are brought together once, and only pairs of
    sufficient Jaccard similarity of their whole shingle sets are linked.  Equal texts are one class
    before that, named by half of their digest.
    """
    texts = keyed_texts(docs.where(F.col(id_col).isNotNull()), id_col, text_col)
    signed = materialize(sampled_signatures(texts, ngram, tables, sample, width))
    words = [f"w{k}" for k in range(width)]
    classes = signed.groupBy("t0", "t1").agg(F.min("id").alias("id"), F.first("bytes").alias("bytes"), *(F.first(w).alias(w) for w in [*words, "keys"]))
    classes = materialize(classes.withColumn("node", F.col("t0")))
    index = classes.select(F.explode("keys").alias("key"), "node", *words)
    loose = connected_components(bucket_links(index, width, bits_apart(similarity, width)))
    placed = materialize(classes.join(loose, "node").select("id", "t0", "t1", "bytes", "node", F.col("component").alias("group")))
    parts = lambda limit: F.ceil((F.sum("bytes") + 1) / F.lit(limit))
    blocks = placed.groupBy("group").agg(F.greatest(parts(GROUP_BYTES), F.least(F.lit(PARTS), parts(PART_BYTES))).alias("blocks"))
    dealt = placed.join(blocks, "group").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("id", "t0", "t1", "node", F.xxhash64("group", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"))
    # An id may stand for several texts: only the class's own counts.
    component = connected_components(exact_links(texts.join(dealt, ["id", "t0", "t1"]), ngram, similarity), tied=True)
    return signed.select("id", "t0", "t1"), classes.join(component, "node", "left").select("t0", "t1", "id", F.coalesce("component", "node").alias("root"))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(id, component_id)`` of rows with an id: those whose texts are linked, directly or by others, share the least id among them (see ``text_classes``)."""
    rows, rooted = text_classes(docs, id_col, text_col, **options)
    leaders = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    found = rooted.join(leaders, "root").select("t0", "t1", "component_id")
    return rows.join(found, ["t0", "t1"]).select(F.col("id").alias(id_col), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``docs`` of each near-duplicate group; rows without an id all stay.

    The row of the least id stays; of several texts under that id the one of the least digest, and of
    rows that repeat both the one of the least hash over all columns.  Texts that share an id and
    nothing else are documents of their own.  An empty table stays empty.
    """
    _, rooted = text_classes(docs, id_col, text_col, **options)
    names = [free_name(docs, f"_{x}") for x in ("id", "t0", "t1")]
    best = rooted.groupBy("root").agg(F.min(F.struct("id", "t0", "t1")).alias("best"))
    leaders = best.select(*(F.col(f"best.{x}").alias(n) for x, n in zip(("id", "t0", "t1"), names, strict=True)))
    own = docs.withColumns(dict(zip(names, (F.col(id_col).cast("long"), *text_digest(text_col)), strict=True)))
    kept = own.join(leaders, names, "left_semi").groupBy(*names).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns))).alias("_row"))
    return kept.select("_row.*").unionByName(docs.where(F.col(id_col).isNull())).select(*docs.columns)
