"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame functions only.

A text is cut into paragraphs (lines; long lines at sentence ends, longer ones every few words, what
has no such words every few bytes), each digested by XXH64.  A sketch has 24 cells in three rows of eight; a digest falls into one cell of
each row, and a cell holds a count, the XOR of its digests and the XOR of their checks.  Sketches
of two versions are subtracted cell by cell, which cancels what they share; peeling cells with one
digest left then recovers the digests on either side.  Where that fails, the digests are dealt by
hash into as many blocks as the difference can need, each block sketched and peeled like the
whole, which is the same table made larger; blocks that still fail are dealt out again by other
bits, and what is left after that is compared digest by digest.

Null and empty texts have no paragraphs: their sketch is empty and they are alike to each other (1.0)
and to nothing else (0.0).  A fingerprint depends on the text alone.  Repeated rows are versions of their
own, each the next of another; extra columns are not read; very long texts are cut whole, within one
row's memory; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.llm._common import text_or_empty

ROWS, WIDTH = 3, 8
#: Cells in a row of a block, digests of a difference that a block is dealt, and rounds of peeling at most of the first sketch and of a block.
BLOCK_WIDTH, LOAD, ROUNDS, BLOCK_ROUNDS = 2, 6, 12, 5
#: Code points of a paragraph before it is cut at sentence ends and words, and of a piece before it is cut after bytes.
LONG, UNCUT = 30, 120
#: Behind one byte value of 16, spread over all of them.
CUT_BYTES = "(?<=[" + "".join(f"\\x{b:02x}" for b in range(256) if (b * 167 >> 2) % 16 == 3) + "])"
CELL = "struct<n:int,x:bigint,c:bigint>"
#: Neighbouring documents per bucket of the ordering by id, and buckets; of more documents each has its share.
BUCKET_ROWS, MAX_BUCKETS = 500, 65_536


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text, by rules that an edit elsewhere does not disturb.

    These are its lines; a line over LONG is cut at sentence ends, what is still over LONG after some
    words (by their last letter), and what none of this cuts to UNCUT, in any script or without
    spaces, after some bytes of its UTF-8 form.  The rules are the same at all lengths, so that an
    edit that shortens a text does not cut it otherwise.
    """
    after_bytes = lambda w: F.when(F.length(w) <= UNCUT, F.array(w)).otherwise(F.split(F.decode(F.encode(w, "UTF-8"), "ISO-8859-1"), CUT_BYTES))
    after_words = lambda q: F.when(F.length(q) <= LONG, F.array(q)).otherwise(F.flatten(F.transform(F.split(q, r"(?<=[\w,|!*$%&#]{2}[g,|!*$%&#])\s+"), after_bytes)))
    lines = F.split(text, r"\n+")
    cut = F.transform(lines, lambda p: F.when(F.length(p) <= LONG, F.array(p)).otherwise(F.flatten(F.transform(F.split(p, r"(?<=[.!?])\s+"), after_words))))
    return F.filter(F.flatten(cut), lambda p: p != "")


def digests(text: Column) -> Column:
    """Distinct digests of the paragraphs of a text."""
    return F.array_distinct(F.transform(paragraphs(text), lambda p: F.xxhash64(p)))


def _check(x: Column) -> Column:
    return F.hash(x).cast("long")


def _empty() -> Column:
    return F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("c"))


def _places(width: int, shift: int) -> Column:
    """Per cell the bits of a digest that decide on it, and their value there: rows of ``width`` cells, from bit ``shift`` on."""
    bits = width.bit_length() - 1
    cells = [((width - 1) << (shift + r * bits), c << (shift + r * bits)) for r in range(ROWS) for c in range(width)]
    return F.expr("array(" + ",".join(f"named_struct('m',{m}L,'v',{v}L)" for m, v in cells) + ")")


def _join(cell: Column, x: Column, n: Column) -> Column:
    return F.struct((cell["n"] + n).alias("n"), cell["x"].bitwiseXOR(x).alias("x"), cell["c"].bitwiseXOR(_check(x)).alias("c"))


def sketch(found: Column, width: int = WIDTH, shift: int = 0) -> Column:
    """Cells of an array of digests: rows of ``width`` cells, addressed by the digests' bits from ``shift`` on."""
    return F.transform(_places(width, shift), lambda s: F.aggregate(found, _empty(), lambda cell, x: F.when(x.bitwiseAND(s["m"]) == s["v"], _join(cell, x, F.lit(1))).otherwise(cell)))


def subtract(a: Column, b: Column) -> Column:
    """Cells of one sketch less those of another."""
    return F.zip_with(a, b, lambda p, q: F.struct((p["n"] - q["n"]).alias("n"), p["x"].bitwiseXOR(q["x"]).alias("x"), p["c"].bitwiseXOR(q["c"]).alias("c")))


def peel(cells: Column, width: int = WIDTH, shift: int = 0, rounds: int = ROUNDS) -> Column:
    """``(ok, left, right)``: digests that only the first or only the second version has, recovered from subtracted cells."""
    none = F.array().cast("array<struct<x:bigint,n:int>>")
    start = F.struct(cells.alias("cells"), none.alias("found"), F.lit(False).alias("still"))
    places = _places(width, shift)

    def one_round(acc: Column, _: Column) -> Column:
        pure = F.array_distinct(F.transform(F.filter(acc["cells"], lambda c: (F.abs(c["n"]) == 1) & (_check(c["x"]) == c["c"])), lambda c: F.struct(c["x"].alias("x"), c["n"].alias("n"))))

        def without(got: Column) -> Column:
            rest = F.zip_with(acc["cells"], places, lambda c, s: F.aggregate(got, c, lambda d, p: F.when(p["x"].bitwiseAND(s["m"]) == s["v"], _join(d, p["x"], -p["n"])).otherwise(d)))
            return F.when(F.size(got) == 0, F.struct(acc["cells"].alias("cells"), acc["found"].alias("found"), F.lit(True).alias("still"))).otherwise(F.struct(rest.alias("cells"), F.concat(acc["found"], got).alias("found"), F.lit(False).alias("still")))

        return F.when(acc["still"], acc).otherwise(let(pure, without))

    def finish(acc: Column) -> Column:
        ok = ~F.exists(acc["cells"], lambda c: (c["n"] != 0) | (c["x"] != 0) | (c["c"] != 0))
        return F.struct(
            ok.alias("ok"),
            F.transform(F.filter(acc["found"], lambda p: p["n"] == 1), lambda p: p["x"]).alias("left"),
            F.transform(F.filter(acc["found"], lambda p: p["n"] == -1), lambda p: p["x"]).alias("right"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, one_round, finish)


def _exact(a: Column, b: Column) -> Column:
    return F.struct(F.lit(True).alias("ok"), F.array_except(a, b).alias("left"), F.array_except(b, a).alias("right"))


def _dealt(a: Column, b: Column, blocks: Column, shift: int, inner: Callable[[Column, Column], Column]) -> Column:
    """Deal digests by hash into ``blocks`` blocks or more, solve each, and put the answers together."""

    def by_side(side: Column) -> Column:
        def parts(p: Column, q: Column, low: int, side: Column = side) -> Column:
            part = lambda x: F.pmod(F.shiftrightunsigned(x, low), side)
            return F.transform(F.sequence(F.lit(0).cast("long"), side - 1), lambda i: F.struct(F.filter(p, lambda x: part(x) == i).alias("a"), F.filter(q, lambda x: part(x) == i).alias("b")))

        pairs = F.flatten(F.transform(parts(a, b, shift), lambda p: parts(p["a"], p["b"], shift + 16, F.ceil(blocks / side).cast("long"))))
        solved = F.transform(pairs, lambda p: F.when((F.size(p["a"]) > 0) & (F.size(p["b"]) > 0), inner(p["a"], p["b"])).otherwise(_one_sided(p["a"], p["b"])))
        return let(solved, lambda s: F.struct(F.lit(True).alias("ok"), F.flatten(F.transform(s, lambda r: r["left"])).alias("left"), F.flatten(F.transform(s, lambda r: r["right"])).alias("right")))

    return let(F.ceil(F.sqrt(blocks)).cast("long"), by_side)


def _one_sided(a: Column, b: Column) -> Column:
    """The answer where a block is empty on one side: all that the other holds."""
    return F.struct(F.lit(True).alias("ok"), a.alias("left"), b.alias("right"))


def _or_else(first: Column, then: Column) -> Column:
    return let(first, lambda r: F.when(r["ok"], r).otherwise(then))


def _compared(a: Column, b: Column, shift: int) -> Column:
    return peel(subtract(sketch(a, BLOCK_WIDTH, shift), sketch(b, BLOCK_WIDTH, shift)), BLOCK_WIDTH, shift, BLOCK_ROUNDS)


def difference(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """``(ok, left, right)`` of two versions from their sketches, from larger ones where those fail."""
    third = lambda p, q: _or_else(_compared(p, q, 15), _exact(p, q))
    second = lambda p, q: _or_else(_compared(p, q, 9), _dealt(p, q, F.lit(9), 30, third))
    blocks = F.ceil((F.size(a) + F.size(b)) / F.lit(LOAD))
    return _or_else(peel(subtract(sketch_a, sketch_b)), _dealt(a, b, blocks, 22, second))


def likeness(a: Column, b: Column, diff: Column) -> Column:
    """Share of the paragraphs of either version that both have (1 for two empty ones)."""
    union = F.size(a) + F.size(diff["right"])
    return F.when(union == 0, 1.0).otherwise((F.size(a) - F.size(diff["left"])) / union)


def as_text(found: Column, cells: Column) -> Column:
    """A fingerprint as a string: the number of paragraphs, then the cells; empty cells are empty."""
    cell = lambda c: F.when(c["n"] == 0, "").otherwise(F.concat_ws(":", c["n"].cast("string"), F.lower(F.hex(c["x"])), F.lower(F.hex(c["c"]))))
    return F.concat(F.size(found).cast("string"), F.lit("|"), F.array_join(F.transform(cells, cell), ","))


def with_next(docs: DataFrame, id_col: str, text_col: str, derive: Callable[[DataFrame], DataFrame], columns: list[str], prefix: str = "next_") -> DataFrame:
    """``derive(docs)`` with ``prefix`` + column of the next row in descending id; after the last comes the first.

    Rows that share an id follow one another by a hash of their text, then by their text; rows without
    an id come last.  The order is cut into buckets of some BUCKET_ROWS rows, at most MAX_BUCKETS, at
    quantiles of the id; an id of more rows than two buckets is cut by the hash.  Of the next bucket's
    rows those of its first key are dealt to a bucket as well.  ``derive`` works on the rows before they
    are shuffled: behind the shuffle its columns would be inlined into the window's and made anew.
    """
    spark = docs.sparkSession
    hashed = F.shiftrightunsigned(F.xxhash64(text_col), 1)
    n = docs.count()
    per = max(BUCKET_ROWS, n // MAX_BUCKETS + 1)
    hot = docs.groupBy(id_col).agg(F.count("*").alias("n")).where(F.col("n") > 2 * per).collect()  # n / (2 * per) rows at most
    cuts = docs.agg(F.percentile_approx(id_col, [k / (n // per) for k in range(1, n // per)], 20 * (n // per))).first()[0] if n >= 2 * per else None
    bounds = sorted({*(cuts or []), *(x for r in hot if r[0] is not None for x in (r[0] - 1, r[0]))})
    step = max(1, int(len(bounds) ** 0.5))
    array = lambda xs: F.expr(f"array({','.join(f'{x}L' for x in xs)})") if xs else F.array().cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda b: b < F.col(id_col)))
    outer = docs.withColumn("_outer", below(array(bounds[step - 1 :: step])))
    major = F.coalesce(F.lit(len(bounds)) - F.col("_outer") * step - below(F.slice(array(bounds), F.col("_outer") * step + 1, step)), F.lit(len(bounds) + 1))
    parts = spark.createDataFrame([(r[0], -(-r["n"] // per)) for r in hot], "_hot long, _parts long")
    placed = outer.withColumn("_major", F.when(F.col(id_col).isNull(), len(bounds) + 1).otherwise(major)).withColumn("_h", hashed)
    placed = placed.join(F.broadcast(parts), F.col(id_col).eqNullSafe(F.col("_hot")), "left") if hot else placed.withColumn("_parts", F.lit(None).cast("long"))
    minor = F.coalesce(F.least(F.floor(F.col("_h") / F.lit(2.0**63) * F.col("_parts")), F.col("_parts") - 1), F.lit(0))
    placed = placed.withColumn("_bucket", F.col("_major").cast("long") * F.lit(MAX_BUCKETS) + minor).drop("_outer", "_major", "_hot", "_parts")
    firsts = placed.groupBy("_bucket").agg(F.min(F.struct((-F.col(id_col)).alias("i"), "_h")).alias("f")).collect()  # a row per bucket
    firsts = sorted((r["_bucket"], None if r["f"]["i"] is None else -r["f"]["i"], r["f"]["_h"]) for r in firsts)
    heads = [(b, i, h, firsts[k - 1][0]) for k, (b, i, h) in enumerate(firsts)]
    head = spark.createDataFrame(heads, "_bucket long, _head_id long, _head_h long, _before long")
    dealt = placed.join(F.broadcast(head), "_bucket", "left")
    leads = F.col(id_col).eqNullSafe(F.col("_head_id")) & (F.col("_h") == F.col("_head_h"))
    home = F.struct(F.col("_bucket").alias("bucket"), F.lit(0).alias("ghost"))
    dealt = dealt.withColumn("_deal", F.explode(F.when(leads, F.array(home, F.struct(F.col("_before").alias("bucket"), F.lit(1).alias("ghost")))).otherwise(F.array(home))))
    dealt = dealt.withColumn("_bucket", F.col("_deal.bucket")).withColumn("_ghost", F.col("_deal.ghost")).drop("_deal", "_head_id", "_head_h", "_before")
    order = Window.partitionBy("_bucket").orderBy("_ghost", F.col(id_col).desc_nulls_last(), "_h", text_col)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # a given number keeps small tables from being worked on in one task
    found = derive(dealt).repartition(tasks, "_bucket").withColumn("_next", F.lead(F.struct(*columns)).over(order))
    return found.where("_ghost = 0").select("*", *(F.col(f"_next.{c}").alias(prefix + c) for c in columns)).drop("_bucket", "_ghost", "_next", "_h")


def fingerprint_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text, an edited version of it, their fingerprints and likeness; repeated rows are versions of their own."""
    own = docs.select(F.col(id_col).cast("long").alias(id_col), text_or_empty(text_col).alias("t"))
    own = with_next(own, id_col, "t", lambda x: x.withColumn("d", digests(F.col("t"))).withColumn("s", sketch(F.col("d"))), ["t", "d", "s"])
    n = F.length("t")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("t", F.lit(1), (n - third).cast("int")), F.substring("next_t", F.lit(1), third))
    own = own.select(id_col, n.cast("long").alias("n_chars"), edited.alias("e"), "d", "s", "next_d", "next_s")
    own = own.withColumn("ed", digests(F.col("e"))).withColumn("es", sketch(F.col("ed")))
    own = own.withColumn("edit", difference(F.col("d"), F.col("ed"), F.col("s"), F.col("es"))).withColumn("step", difference(F.col("d"), F.col("next_d"), F.col("s"), F.col("next_s")))
    return own.select(
        id_col,
        "n_chars",
        F.sha2(F.col("e"), 256).alias("edited_sha256"),
        as_text(F.col("d"), F.col("s")).alias("fingerprint"),
        as_text(F.col("ed"), F.col("es")).alias("edited_fingerprint"),
        likeness(F.col("d"), F.col("ed"), F.col("edit")).alias("near_edited"),
        likeness(F.col("d"), F.col("next_d"), F.col("step")).alias("near_next"),
        F.concat(F.size("edit.left"), F.lit("+"), F.size("edit.right")).alias("edited_paragraphs"),
    )
