"""Alignment columns in long form ``(row, col, aa)``; gaps are absent rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.operators.sequences import STANDARD
from meshwright.session import materialize


def long_form(rows: DataFrame, row: str, seq: str, *more: str) -> DataFrame:
    """Non-gap cells of aligned sequences; columns from 0.  Columns ``more`` of a row go with its cells."""
    cells = rows.select(F.col(row).alias("row"), *more, F.posexplode(F.split(F.col(seq), "")).alias("col", "aa"))
    return cells.where(~F.col("aa").isin("-", ".", " ", "")).select("row", *more, "col", F.upper("aa").alias("aa"))


def occupancy(msa: DataFrame, rows: int, least: float = 0.1, reference: int | None = None) -> DataFrame:
    """Columns with a residue in ``least`` of the rows or in the reference's."""
    has = F.max(F.when(F.col("row") == reference, 1).otherwise(0)) if reference is not None else F.lit(0)
    out = msa.groupBy("col").agg(F.count("*").alias("n"), has.alias("ref"))
    return out.where((F.col("n") >= F.lit(least) * rows) | (F.col("ref") == 1)).select("col", "n")


def reference_labels(columns: DataFrame, msa: DataFrame, reference: int) -> DataFrame:
    """Running residue number of the reference; insertions are ``last.k``, k counting gap columns since."""
    ref = msa.where(F.col("row") == reference).select("col", F.lit(1).alias("hit"))
    order = Window.orderBy("col")
    out = columns.select("col").join(ref, "col", "left").withColumn("major", F.coalesce(F.sum("hit").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    out = out.withColumn("minor", F.when(F.col("hit") == 1, 0).otherwise(F.row_number().over(Window.partitionBy("major", F.col("hit").isNull()).orderBy("col"))))
    label = F.when(F.col("minor") == 0, F.col("major").cast("string")).otherwise(F.concat_ws(".", F.col("major").cast("string"), F.col("minor").cast("string")))
    return out.select("col", label.alias("label"))


def composition(msa: DataFrame, rows: int) -> DataFrame:
    """Count and share of all rows of each residue per column."""
    return msa.groupBy("col", "aa").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.lit(rows))


def frequency_columns(msa: DataFrame, rows: int, test) -> DataFrame:
    """Columns where ``test(share)`` holds; ``share(letters)`` is the summed share of residues, ``_`` of gaps."""
    names: dict[str, str] = {}

    def share(letters: str) -> Column:
        names.setdefault(letters, f"_f{len(names)}")
        return F.col(names[letters])

    condition = test(share)
    counts = [((F.lit(rows) - F.count("*")) if k == "_" else F.count_if(F.col("aa").isin(*k))).alias(v) for k, v in names.items()]
    counted = msa.groupBy("col").agg(*counts)
    return counted.select("col", *((F.col(v) / F.lit(rows)).alias(v) for v in names.values())).where(condition).select("col")


def distribution(msa: DataFrame, populations: DataFrame, col: int) -> DataFrame:
    """Residues (gaps as ``-``) at a column per population ``(population, row)``, and over all of them as ``overall``."""
    at = msa.where(F.col("col") == col).select("row", "aa")
    every = populations.unionByName(populations.select(F.lit("overall").alias("population"), "row").distinct())
    cells = every.join(at, "row", "left").groupBy("population", F.coalesce("aa", F.lit("-")).alias("aa")).agg(F.count("*").alias("n"))
    return cells.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("population")))


def consensus(msa: DataFrame, weights: DataFrame, total: float) -> DataFrame:
    """Weightiest standard residue per column (ties: least letter), its share of all weight and the occupancy."""
    w = msa.join(weights, "row").groupBy("col", "aa").agg(F.sum("w").alias("w"))
    std = F.col("aa").isin(*STANDARD)
    out = w.groupBy("col").agg(F.max_by(F.when(std, F.col("aa")), F.when(std, F.struct(F.round("w", 9), -F.ascii("aa")))).alias("aa"), F.max(F.when(std, F.col("w"))).alias("w"), F.sum("w").alias("all"))
    return out.where("aa is not null").select("col", "aa", (F.col("w") / total).alias("share"), (F.col("all") / total).alias("occupancy"))


def logo(msa: DataFrame, bits: bool = True) -> DataFrame:
    """Letter heights: share times max(0, log2 20 - (H + 19 / (2 ln 2 n))), n the column's residues."""
    n = msa.where(F.col("aa").isin(*STANDARD)).groupBy("col", "aa").agg(F.count("*").cast("double").alias("n"))
    w = Window.partitionBy("col")
    p = n.withColumn("t", F.sum("n").over(w)).withColumn("p", F.col("n") / F.col("t"))
    p = p.withColumn("h", -F.sum(F.col("p") * F.log2("p")).over(w))
    info = F.greatest(F.lit(0.0), F.lit(math.log2(20)) - (F.col("h") + F.lit(19 / (2 * math.log(2))) / F.col("t")))
    return p.select("col", "aa", (F.col("p") * info if bits else F.col("p")).alias("height"))


def conserved(aligned: DataFrame, row: str, seq: str, subsets: DataFrame, cmin: float = 0.98, gmax: float = 0.4, eps: float = 1e-9) -> DataFrame:
    """Residues conserved in a subset ``(subset, row)`` and rare outside all subsets that conserve them; ``aligned`` has a sequence for each row.

    Rows count by the set of subsets they are in: each row meets its set before it is cut into cells,
    and what follows works on counts per set.
    """
    sizes = subsets.groupBy("subset").agg(F.count("*").alias("size"))
    sets = subsets.groupBy("row").agg(F.array_sort(F.collect_set("subset")).alias("sets"))  # a row's own subsets
    rows = aligned.select(F.col(row).alias("row"), F.col(seq).alias("seq")).join(sets.hint("merge"), "row", "left").withColumn("sets", F.coalesce("sets", F.array().cast(sets.schema["sets"].dataType)))
    counts = materialize(long_form(rows, "row", "seq", "sets").groupBy("sets", "col", "aa").agg(F.count("*").alias("k")))
    kinds = materialize(rows.groupBy("sets").agg(F.count("*").alias("members")))
    member = counts.select(F.explode("sets").alias("subset"), "col", "aa", "k").groupBy("subset", "col", "aa").agg(F.sum("k").alias("n"))
    found = materialize(member.join(sizes, "subset").where((F.col("n") / F.col("size") >= cmin - eps) & ~F.col("aa").isin("X", "B", "Z", "J")))
    keepers = found.groupBy("col", "aa").agg(F.collect_set("subset").alias("keepers"))
    within = F.arrays_overlap("sets", "keepers")
    union = keepers.join(kinds, within).groupBy("col", "aa").agg(F.sum("members").alias("rows_in"))
    hits = counts.join(keepers, ["col", "aa"]).where(within).groupBy("col", "aa").agg(F.sum("k").alias("hit_in"))
    overall = counts.groupBy("col", "aa").agg(F.sum("k").alias("hit"))
    out = found.join(union, ["col", "aa"]).join(overall, ["col", "aa"]).join(hits, ["col", "aa"], "left")
    outside = F.lit(kinds.agg(F.sum("members")).first()[0] or 0) - F.col("rows_in")
    share = (F.col("hit") - F.coalesce("hit_in", F.lit(0))) / outside
    return out.where(outside > 0).withColumn("outside", share).where(F.col("outside") < gmax - eps).select("subset", "col", "aa", (F.col("n") / F.col("size")).alias("inside"), "outside")


def identities(msa: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairwise identity of ``(a, b)``: equal standard residues over columns of the shared window where either has one.

    The window runs from the first to the last column in which both rows hold a residue; without
    one the identity is null.
    """
    x = msa.select(F.col("row").alias("a"), "col", F.col("aa").alias("x"))
    y = msa.select(F.col("row").alias("b"), "col", F.col("aa").alias("y"))
    left = pairs.join(x, "a")
    right = pairs.join(y, "b")
    cells = left.join(right, ["a", "b", "col"], "full")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    window = cells.groupBy("a", "b").agg(F.min(F.when(both, F.col("col"))).alias("first"), F.max(F.when(both, F.col("col"))).alias("last"))
    same = F.count_if((F.col("x") == F.col("y")) & F.col("x").isin(*STANDARD))
    out = cells.join(window, ["a", "b"]).where("col between first and last").groupBy("a", "b").agg((same / F.count("*")).alias("identity"))
    return pairs.join(out, ["a", "b"], "left")


def sort_labels(label: Column) -> list[Column]:
    """Order of position labels ``major.minor``."""
    part = F.split(label, r"\.")
    return [part[0].cast("int").asc(), F.coalesce(F.get(part, F.lit(1)).cast("int"), F.lit(0)).asc()]


def parse_positions(text: str, labels: list[str]) -> list[str]:
    """``[10-20,35.1,(-2)-(-1),END]`` over labels in order: single labels and ranges, each once."""
    import re

    place = {x: k for k, x in enumerate(labels)}
    out: dict[str, None] = {}
    for part in text.strip().strip("[]").split(","):
        m = re.fullmatch(r"\s*(END|\(-\d+(?:\.\d+)?\)|\d+(?:\.\d+)?)\s*(?:-\s*(END|\(-\d+(?:\.\d+)?\)|\d+(?:\.\d+)?))?\s*", part)
        if not m:
            raise ValueError(f"malformed position {part!r}")
        ends = [labels[-1] if x == "END" else x.strip("()") for x in m.groups() if x]
        if any(x not in place for x in ends):
            raise ValueError(f"unknown position in {part!r}")
        s, e = place[ends[0]], place[ends[-1]]
        if e < s:
            raise ValueError(f"range {part!r} runs backwards")
        out |= dict.fromkeys(labels[s : e + 1])
    return list(out)
