"""Profiles of aligned rows by blocks: identity, neighbour weights, group identity, information content, frequency logic as text.

Rows are texts of one length.  Pairs of rows are compared in blocks of BLOCK rows with NumPy, so that a
task holds two blocks of rows and no table of cells is made.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.operators.sequences import STANDARD

#: Rows of a block, and cells of the products that are held at once.
BLOCK, CELLS = 1024, 1 << 24
#: Pairs of a group that are all compared, pairs drawn of a larger one, and their seed.
EXACT_PAIRS, SAMPLE_PAIRS, SEED = 50_000_000, 2_000_000, 42

_CODE = np.full(256, -1, np.int8)
_LETTER = np.zeros(256, bool)
for _k, _a in enumerate(STANDARD):
    _CODE[ord(_a)] = _CODE[ord(_a.lower())] = _k
for _c in range(26):
    _LETTER[65 + _c] = _LETTER[97 + _c] = True


def encode(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes 0..19 of standard residues (-1 for others), and where a row holds any letter."""
    raw = np.frombuffer("".join(rows).encode("ascii", "replace"), np.uint8).reshape(len(rows), -1)
    return _CODE[raw], _LETTER[raw]


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Numbers of columns in which both rows have the same standard residue."""
    out = np.zeros((len(x), len(y)), np.float32)
    for a in range(len(STANDARD)):
        out += (x == a).astype(np.float32) @ (y == a).astype(np.float32).T
    return out


def local_identity(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], local: bool = True) -> np.ndarray:
    """Equal standard residues over the columns where either row has a letter: those from the first to the last in which both have one (NaN without any), or all of them."""
    (cx, ox), (cy, oy) = x, y
    same = _products(cx, cy).astype(np.float64)
    if not local:
        n = ox.sum(1)[:, None] + oy.sum(1)[None, :] - ox.astype(np.float32) @ oy.astype(np.float32).T
        return np.where(n > 0, same / np.maximum(n, 1), np.nan)
    out = np.empty(same.shape)
    step = max(1, CELLS // max(1, oy.size))
    before = np.concatenate((np.zeros((len(oy), 1), np.int64), np.cumsum(oy, axis=1)), axis=1)
    width = ox.shape[1]
    for s in range(0, len(ox), step):
        rows = ox[s : s + step]
        both = rows[:, None, :] & oy[None]
        first, last = both.argmax(2), width - 1 - both[:, :, ::-1].argmax(2)
        some = both.any(2)
        mine = np.concatenate((np.zeros((len(rows), 1), np.int64), np.cumsum(rows, axis=1)), axis=1)
        at, j = np.arange(len(rows))[:, None], np.arange(len(oy))[None, :]
        shared = np.concatenate((np.zeros((*both.shape[:2], 1), np.int32), np.cumsum(both, axis=2, dtype=np.int32)), axis=2)
        k = np.broadcast_to(at, first.shape)
        n = mine[at, last + 1] - mine[at, first] + before[j, last + 1] - before[j, first] - (shared[k, j, last + 1] - shared[k, j, first])
        out[s : s + step] = np.where(some, same[s : s + step] / np.maximum(n, 1), np.nan)
    return out


def pair_blocks(rows: DataFrame, row: str, seq: str, use: Callable[[np.ndarray, list[str], np.ndarray, list[str], bool], Iterator[pa.RecordBatch]], schema: str, group: str | None = None) -> DataFrame:
    """Bring every pair of blocks of rows (of one ``group``) together once: ``use(ids a, texts a, ids b, texts b, same block)``.

    Rows are dealt to blocks by hash; the number of blocks follows the rows and the cores, and a pair
    of blocks is one task's work.
    """
    spark = rows.sparkSession
    keys = [group] if group else []
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    least = 1 if group else math.ceil(math.sqrt(2 * spark.sparkContext.defaultParallelism))
    blocks = F.greatest(F.ceil(F.col("_n") / BLOCK), F.least(F.lit(least), F.ceil(F.col("_n") / 32))).cast("int")
    sized = counted.select(*keys, blocks.alias("_blocks"))
    own = rows.select(*keys, F.col(row).cast("long").alias("_row"), F.col(seq).alias("_seq"))
    own = own.join(sized, keys) if keys else own.join(F.broadcast(sized))
    own = own.withColumn("_mine", F.pmod(F.xxhash64("_row"), F.col("_blocks")).cast("int"))
    own = own.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    own = own.select(*(F.col(k).alias("_group") for k in keys), F.least("_mine", "_other").alias("_a"), F.greatest("_mine", "_other").alias("_b"), "_mine", "_row", "_seq")
    keys = [*(["_group"] if keys else []), "_a", "_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, kind = None, [], None

        def settle() -> Iterator[pa.RecordBatch]:
            x = [r[-2:] for r in held if r[-3] == r[-5]]
            y = [r[-2:] for r in held if r[-3] == r[-4]]
            same = held[0][-5] == held[0][-4]
            if x and y:
                for batch in use(np.array([i for i, _ in x], np.int64), [t for _, t in x], np.array([i for i, _ in y], np.int64), [t for _, t in y], same):
                    if len(keys) == 3:
                        batch = pa.RecordBatch.from_arrays([pa.array([current[0]] * batch.num_rows, kind), *batch.columns], ["group", *batch.schema.names])
                    yield batch

        for batch in batches:
            kind = batch.schema.field(0).type
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[: len(keys)] != current:
                    if held:
                        yield from settle()
                    current, held = r[: len(keys)], []
                held.append(r)
        if held:
            yield from settle()

    if group:
        schema = f"group {dict(rows.dtypes)[group]}, {schema}"
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return own.repartition(tasks, *keys).sortWithinPartitions(*keys, "_row").mapInArrow(run, schema)


def identity_pairs(rows: DataFrame, row: str = "row", seq: str = "seq", local: bool = True) -> DataFrame:
    """``(a, b, identity)`` of all pairs a < b; null where a pair has no alignment."""

    def use(i, x, j, y, same):
        v = local_identity(encode(x), encode(y), local)
        r, c = np.nonzero(i[:, None] < j[None, :]) if same else np.nonzero(i[:, None] != j[None, :])
        values = v[r, c]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i[r], j[c])), pa.array(np.maximum(i[r], j[c])), pa.array(values, mask=np.isnan(values))], ["a", "b", "identity"])

    return pair_blocks(rows, row, seq, use, "a long, b long, identity double")


def identity_weights(rows: DataFrame, threshold: float, row: str = "row", seq: str = "seq") -> DataFrame:
    """``(row, weight)``: one over the number of rows (itself included) whose identity, over columns where either has a standard residue, reaches ``threshold``.

    Rows that are alike in their standard residues are compared once and counted as often as they occur.
    """
    plain = F.regexp_replace(F.upper(F.col(seq)), f"[^{STANDARD}]", "-")
    own = rows.select(F.col(row).alias("row"), plain.alias("_plain"))
    kinds = own.groupBy("_plain").agg(F.min("row").alias("row"), F.count("*").alias("n"))

    def use(i, x, j, y, same):
        n = np.array([int(t.split("\n")[0]) for t in x]), np.array([int(t.split("\n")[0]) for t in y])
        (cx, _), (cy, _) = (encode([t.split("\n")[1] for t in z]) for z in (x, y))
        ox, oy = cx >= 0, cy >= 0
        union = ox.sum(1)[:, None] + oy.sum(1)[None, :] - ox.astype(np.float32) @ oy.astype(np.float32).T
        near = (union > 0) & (_products(cx, cy) >= threshold * union - 1e-12)
        out = [(i, near @ n[1])] if same else [(i, near @ n[1]), (j, n[0] @ near)]
        for ids, count in out:
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(count.astype(np.int64))], ["row", "near"])

    counted = kinds.withColumn("_text", F.concat(F.col("n").cast("string"), F.lit("\n"), F.col("_plain")))
    near = pair_blocks(counted, "row", "_text", use, "row long, near long").groupBy("row").agg(F.sum("near").alias("near"))
    weights = kinds.join(near, "row").select("_plain", (1 / F.greatest("near", F.lit(1))).alias("weight"))
    return own.join(weights, "_plain").select("row", "weight")


def group_identity(rows: DataFrame, group: str, row: str = "row", seq: str = "seq", exact_pairs: int = EXACT_PAIRS, sample_pairs: int = SAMPLE_PAIRS) -> DataFrame:
    """``(group, members, pairs, mean, least, sampled)`` in percent; pairs without an alignment do not count, noise (-1) is left out.

    A group of more than ``exact_pairs`` pairs compares ``sample_pairs`` drawn ones: as many blocks as
    that takes, by a hash of the rows with a fixed seed.
    """
    own = rows.where(F.col(group) != -1)
    sizes = own.groupBy(group).agg(F.count("*").alias("members"))
    pairs = F.col("members") * (F.col("members") - 1) / 2
    sizes = sizes.withColumn("sampled", pairs > exact_pairs).withColumn("_share", F.when(pairs > exact_pairs, F.sqrt(F.lit(sample_pairs) / pairs)).otherwise(1.0))
    drawn = own.join(sizes, group).where(F.pmod(F.xxhash64(F.lit(SEED), F.col(row)), F.lit(1 << 30)) < F.col("_share") * (1 << 30))

    def use(i, x, j, y, same):
        v = local_identity(encode(x), encode(y))
        v = v[i[:, None] < j[None, :]] if same else v.ravel()
        v = v[~np.isnan(v)]
        if len(v):
            yield pa.RecordBatch.from_arrays([pa.array([len(v)], pa.int64()), pa.array([float(v.sum())]), pa.array([float(v.min())])], ["pairs", "total", "least"])

    found = pair_blocks(drawn, row, seq, use, "pairs long, total double, least double", group).groupBy("group").agg(F.sum("pairs").alias("pairs"), (100 * F.sum("total") / F.sum("pairs")).alias("mean"), (100 * F.min("least")).alias("least"))
    return sizes.select(F.col(group).alias("group"), "members", "sampled").join(found, "group", "left").select("group", "members", F.coalesce("pairs", F.lit(0)).alias("pairs"), "mean", "least", "sampled")


def cross_identity(rows: DataFrame, other: DataFrame, row: str = "row", seq: str = "seq") -> DataFrame:
    """``(a, b, identity)`` of rows against others; ``other`` is dealt to blocks and each meets a block of ``rows`` once."""
    marked = rows.select((F.col(row) * 2).alias("row"), F.col(seq).alias("seq")).unionByName(other.select((F.col(row) * 2 + 1).alias("row"), F.col(seq).alias("seq")))

    def use(i, x, j, y, same):
        ids, texts = np.concatenate((i, j)) if not same else i, x + y if not same else x
        left, right = np.flatnonzero(ids % 2 == 0), np.flatnonzero(ids % 2 == 1)
        if not len(left) or not len(right):
            return
        v = local_identity(encode([texts[k] for k in left]), encode([texts[k] for k in right]))
        mine = np.concatenate((np.zeros(len(i), bool), np.ones(len(j), bool))) if not same else np.zeros(len(i), bool)
        r, c = np.nonzero(np.ones_like(v, bool) if same else mine[left][:, None] != mine[right][None, :])
        values = v[r, c]
        yield pa.RecordBatch.from_arrays([pa.array(ids[left[r]] // 2), pa.array(ids[right[c]] // 2), pa.array(values, mask=np.isnan(values))], ["a", "b", "identity"])

    return pair_blocks(marked, "row", "seq", use, "a long, b long, identity double")


def identity_means(pairs: DataFrame) -> DataFrame:
    """``(row, pairs, mean)``: the mean identity of each row with all others."""
    both = pairs.select(F.col("a").alias("row"), "identity").unionByName(pairs.select(F.col("b").alias("row"), "identity"))
    return both.groupBy("row").agg(F.count("identity").alias("pairs"), F.avg("identity").alias("mean"))


def identity_table(pairs: DataFrame, names: list[int]) -> DataFrame:
    """Rows against rows in percent with two decimals, blank where undefined, 100.00 on the diagonal; ``names`` are the columns, which bound the table's width."""
    both = pairs.select("a", "b", "identity").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "identity"))
    shown = F.when(F.col("identity").isNull(), "").otherwise(F.format_string("%.2f", F.col("identity") * 100))
    wide = both.where(F.col("a").isin(names) & F.col("b").isin(names)).withColumn("v", shown).groupBy("a").pivot("b", names).agg(F.first("v"))
    cell = lambda n: F.when(F.col("a") == n, "100.00").otherwise(F.coalesce(F.col(str(n)), F.lit("")))
    return wide.select(F.col("a").alias("row"), *(cell(n).alias(str(n)) for n in names))


def weighted_logo(msa: DataFrame, weights: DataFrame, bits: bool = True, with_gap: bool = True) -> DataFrame:
    """Letter heights of ``msa (row, col, aa)`` with ``weights (row, weight)``: p times the information of the column's weight, times the share of all weight that has a residue there."""
    total = weights.agg(F.sum("weight").alias("_all"))
    n = msa.where(F.col("aa").isin(*STANDARD)).join(weights, "row").groupBy("col", "aa").agg(F.sum("weight").alias("n"))
    w = Window.partitionBy("col")
    p = n.withColumn("t", F.sum("n").over(w)).withColumn("p", F.col("n") / F.col("t")).join(F.broadcast(total))
    p = p.withColumn("h", -F.sum(F.col("p") * F.log2("p")).over(w))
    info = F.greatest(F.lit(0.0), F.lit(math.log2(20)) - (F.col("h") + F.lit(19 / (2 * math.log(2))) / F.col("t")))
    height = F.col("p") * info if bits else F.col("p")
    return p.select("col", "aa", (height * F.col("t") / F.col("_all") if with_gap else height).alias("height"))


def information_content(msa: DataFrame, rows: int) -> DataFrame:
    """Per cell of ``msa (row, col, aa)``: ``information``, the column's logo height in percent of log2 20, and ``agreement``, the percentage of the column's standard residues that are the same (null for others); to two digits."""
    n = msa.where(F.col("aa").isin(*STANDARD)).groupBy("col", "aa").agg(F.count("*").cast("double").alias("n"))
    t = n.groupBy("col").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"))
    entropy = F.log2("t") - F.col("nlogn") / F.col("t")
    info = F.greatest(F.lit(0.0), F.lit(math.log2(20)) - (entropy + F.lit(19 / (2 * math.log(2))) / F.col("t"))) * F.col("t") / rows
    columns = t.select("col", "t", (100 * info / math.log2(20)).alias("information"))
    found = msa.join(columns, "col", "left").join(n, ["col", "aa"], "left")
    return found.select("row", "col", "aa", F.round(F.coalesce("information", F.lit(0.0)), 2).alias("information"), F.round(100 * F.col("n") / F.col("t"), 2).alias("agreement"))


_CONDITION = re.compile(r"\(\s*(\([^()\s]{2,}\)|[A-Za-z_]+)\s*(>=|<=|>|<)\s*([0-9.]+%?)\s*\)")
_BARE = re.compile(r"\s*(\([^()\s]{2,}\)|[A-Za-z_]+)\s*(>=|<=|>|<)\s*([0-9.]+%?)\s*")
_COMPARE = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}


def frequency_logic(text: str) -> Callable[[Callable[[str], Column]], Column]:
    """Parse ``[(K>10%)&!((DE)>=0.2)|(_>50)]`` for ``alignment.frequency_columns``.

    A condition compares the share of a residue, a group in parentheses, or gaps (``_`` or GAP) with a
    percentage, a share up to 1, or a number above 1, a percentage too.  ``!`` binds before ``&``, then
    ``^``, then ``|``.  A single condition needs no parentheses.
    """
    inner = text.strip()
    inner = inner[1:-1] if inner.startswith("[") and inner.endswith("]") else inner
    single = _BARE.fullmatch(inner)
    inner = f"({inner})" if single else inner
    tokens, at = [], 0
    while at < len(inner):
        if inner[at].isspace():
            at += 1
        elif m := _CONDITION.match(inner, at):
            tokens.append(m.groups())
            at = m.end()
        elif inner[at] in "()!&^|":
            tokens.append(inner[at])
            at += 1
        else:
            raise ValueError(f"each condition stands in parentheses, as (K>10%): {text!r}")

    def condition(target: str, sign: str, value: str) -> Callable:
        letters = target.strip("()").upper()
        if letters == "GAP":
            letters = "_"
        if not target.startswith("(") and len(letters) != 1:
            raise ValueError(f"unknown target {target!r}: a residue, GAP, _ or a group such as (KR)")
        limit = float(value[:-1]) / 100 if value.endswith("%") else float(value) if float(value) <= 1 else float(value) / 100
        return lambda share: _COMPARE[sign](share(letters), F.lit(limit))

    place = 0

    def take(sign: str) -> bool:
        nonlocal place
        if place < len(tokens) and tokens[place] == sign:
            place += 1
            return True
        return False

    def level(signs: str) -> Callable:
        if not signs:
            return unary()
        first = level(signs[1:])
        while take(signs[0]):
            join = {"|": lambda a, b: a | b, "^": lambda a, b: a != b, "&": lambda a, b: a & b}[signs[0]]
            first = (lambda a, b, join: lambda share: join(a(share), b(share)))(first, level(signs[1:]), join)
        return first

    def unary() -> Callable:
        nonlocal place
        if take("!"):
            inside = unary()
            return lambda share: ~inside(share)
        if take("("):
            inside = level("|^&")
            if not take(")"):
                raise ValueError(f"a parenthesis is not closed in {text!r}")
            return inside
        if place < len(tokens) and isinstance(tokens[place], tuple):
            place += 1
            return condition(*tokens[place - 1])
        raise ValueError(f"incomplete expression {text!r}")

    out = level("|^&")
    if place != len(tokens):
        raise ValueError(f"unexpected {tokens[place]!r} in {text!r}")
    return out


def offset_label(label: Column, offset: int) -> Column:
    """A position label with its whole number moved, insertions kept: 12.3 and 5 make 17.3."""
    part = F.split(label, r"\.", 2)
    moved = (part[0].cast("long") + offset).cast("string")
    return F.when(F.size(part) > 1, F.concat_ws(".", moved, F.get(part, F.lit(1)))).otherwise(moved)
