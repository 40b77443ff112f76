"""Weighted undirected edges: scoring, reduction, normalization, cut-offs, top-k and statistics.

Edges are rows ``(i, j, score)`` with i < j.  Every operator is a composition of DataFrame
operators; ties are settled by explicit columns, never by the order in which rows arrive.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.operators.vectors import Counts, all_pairs

#: Bins of a pass that narrows the values of a rank down, and values that are looked at singly.
RANK_BINS, RANK_VALUES = 1024, 10_000
#: Lengths of a block's rows whose factors are kept.
LENGTHS = 64


def length_factors(x: np.ndarray, y: np.ndarray, power: float) -> Callable[[int, np.ndarray], np.ndarray]:
    """What makes adjusted scores, in place, of cosines of rows from a first one on and all columns, whose lengths are x and y.

    Where rows have few lengths, a power is taken for each of these and a column, not for every pair.
    """
    factor = lambda v: (np.minimum(v[:, None], y) / np.maximum(np.maximum(v[:, None], y), 1)) ** power
    lengths, at = np.unique(x, return_inverse=True)
    rows = factor(lengths) if len(lengths) <= LENGTHS else None

    def adjust(s: int, score: np.ndarray) -> np.ndarray:
        np.clip(score, -1, 1, out=score)
        score *= factor(x[s : s + len(score)]) if rows is None else rows[at[s : s + len(score)]]
        return score

    return adjust


def length_adjusted_pairs(vectors: DataFrame, id_col: str, vector_col: str, lengths: DataFrame, power: float, digits: int | None = None) -> DataFrame:
    """Cosine of pooled vectors, within -1 and 1, times (shorter / longer length) to a power; ``lengths (id, length)``.

    A length is the last entry of its vector, so that pairs meet it where they are scored.
    """

    length = F.greatest(F.col("length"), F.lit(0)).cast("double")
    both = vectors.join(lengths.select(id_col, length.alias("_length")), id_col).select(id_col, F.concat(F.col(vector_col).cast("array<double>"), F.array("_length")).alias("_v"))
    return all_pairs(both, id_col, "_v", digits, extra=1, finish=lambda x, y: length_factors(x[:, 0], y[:, 0], power))


def pooled(store: DataFrame, id_col: str, residues: str, pooling: str = "mean") -> DataFrame:
    """``(id, v)``: the greatest or the mean value of each feature over a record's residues (``array<array<double>>``)."""
    if pooling not in ("max", "mean"):
        raise ValueError(f"unknown pooling {pooling!r}; known: max, mean")
    cells = store.select(F.col(id_col).alias("id"), F.explode(residues).alias("r")).select("id", F.posexplode("r").alias("k", "x"))
    each = cells.groupBy("id", "k").agg((F.max("x") if pooling == "max" else F.avg("x")).alias("x"))
    return each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("v"))


def reduce_max(edges: DataFrame, i: str = "i", j: str = "j", score: str = "score") -> DataFrame:
    """One row per unordered pair with its greatest score; self pairs go."""
    return edges.where(F.col(i) != F.col(j)).groupBy(F.least(i, j).alias("i"), F.greatest(i, j).alias("j")).agg(F.max(score).alias("score"))


def _denominator(mode: str, aligned: Column, left: Column, right: Column) -> Column:
    modes = {"alignment_length": aligned, "shorter": F.least(left, right), "longer": F.greatest(left, right), "average": (left + right) / F.lit(2.0)}
    if mode not in modes:
        raise ValueError(f"unknown normalization {mode!r}; known: {', '.join(modes)}")
    return modes[mode].cast("double")


def normalize(score: Column, aligned: Column, left: Column, right: Column, mode: str) -> Column:
    """Score per length; 0 where the length is not positive."""
    d = _denominator(mode, aligned, left, right)
    return F.when(d > 0, score / d).otherwise(0.0)


def normalize_floored(score: Column, aligned: Column, left: Column, right: Column, mode: str, floor: float = 1e-6) -> Column:
    """Score per length, the length floored (statistics)."""
    return score / F.greatest(_denominator(mode, aligned, left, right), F.lit(floor))


def evalue_score(evalue: Column) -> Column:
    """-log10(E), capped at 300 by the summand."""
    return -F.log10(evalue + F.lit(1e-300))


def alignment_score(bits: Column, left: Column, right: Column) -> Column:
    """bits log10(2) - log10(left * right); may be negative."""
    return bits * F.lit(float(np.log10(2))) - F.log10(left * right)


def at_least(edges: DataFrame, threshold: float, score: str = "score", rule: str = "statistics") -> DataFrame:
    """Edges from a threshold on.  ``layout`` rounds it to single precision, ``statistics`` compares exactly."""
    if rule not in ("layout", "statistics"):
        raise ValueError(f"unknown rule {rule!r}")
    t = F.lit(threshold).cast("float") if rule == "layout" else F.lit(threshold).cast("double")
    return edges.where((F.col(score) >= t) & ~F.isnan(score))


def strongest_directed(edges: DataFrame, k: int, pos: str = "pos", score: str = "score") -> DataFrame:
    """Edges among the best k of their source or the best k of their target: score descending, earlier first, NaN last."""
    order = [F.isnan(score).asc(), F.col(score).desc_nulls_last(), F.col(pos).asc()]
    kept = [edges.withColumn("_r", F.row_number().over(Window.partitionBy(end).orderBy(*order))).where(f"_r <= {k}").drop("_r") for end in ("i", "j")]
    return kept[0].unionByName(kept[1]).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge from either end: ``(node, other, score)``; loops go."""
    e = edges.where("i <> j")
    return e.select(F.col("i").alias("node"), F.col("j").alias("other"), "score").unionByName(e.select(F.col("j").alias("node"), F.col("i").alias("other"), "score"))


def nearest_partners(edges: DataFrame, k: int) -> DataFrame:
    """The k strongest partners of every node: ``(node, rank, other, score)``; ties by partner."""
    best = both_ways(edges).groupBy("node", "other").agg(F.max("score").alias("score"))
    w = Window.partitionBy("node").orderBy(F.isnan("score").asc(), F.col("score").desc(), F.col("other").asc())
    return best.withColumn("rank", F.row_number().over(w)).where(f"rank <= {k}").select("node", "rank", "other", "score")


def ranked_values(rows: DataFrame, column: str, ranks: list[int]) -> list[float]:
    """The values at ``ranks`` (0 the least) of a column without nulls or NaN, exactly and in bounded memory.

    Each pass counts the values of every rank's range in bins and goes on with the bin that holds the
    rank, until it holds one value or few enough to look at singly.  ``rows`` is read in each pass.
    """
    out: dict[int, float] = {}
    low, high = rows.agg(F.min(column), F.max(column)).first()
    todo = {r: (float(low), float(high), r) for r in set(ranks)}  # rank -> range, and place within it
    x = F.col(column).cast("double")
    while todo := {r: v for r, v in todo.items() if r not in out}:
        for r, (lo, hi, _) in todo.items():
            if lo == hi:
                out[r] = lo
        spans = sorted({(lo, hi) for lo, hi, _ in todo.values() if lo < hi})
        if not spans:
            continue
        kinds = F.array(*(F.when(x.between(F.lit(lo), F.lit(hi)), F.struct(F.lit(k).alias("k"), F.least(F.floor((x - F.lit(lo)) / F.lit((hi - lo) / RANK_BINS)), F.lit(RANK_BINS - 1)).alias("bin"))) for k, (lo, hi) in enumerate(spans)))
        binned = rows.select(x.alias("x"), F.explode(F.array_compact(kinds)).alias("s"))
        found: dict[int, list] = {}
        for row in binned.groupBy("s.k", "s.bin").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect():  # bins of each range
            found.setdefault(row["k"], []).append((row["lo"], row["hi"], row["n"]))
        few = []
        for r, (lo, hi, place) in list(todo.items()):
            if r in out:
                continue
            for a, b, n in sorted(found[spans.index((lo, hi))]):
                if place < n:
                    todo[r] = (a, b, place)
                    few += [r] if a < b and n <= RANK_VALUES // len(ranks) else []
                    break
                place -= n
        if few:
            wanted = sorted({todo[r][:2] for r in few})
            inside = F.lit(False)
            for a, b in wanted:
                inside = inside | x.between(F.lit(a), F.lit(b))
            values = np.array(sorted(row[0] for row in rows.where(inside).select(x).collect()))
            for r in few:
                a, b, place = todo[r]
                out[r] = float(values[np.searchsorted(values, a) + place])
    return [out[r] for r in ranks]


def percent_cutoff(edges: DataFrame, nodes: int, percent: float) -> float:
    """Score of the e-th best edge, e = percent of the possible pairs (1 .. stored); NaN counts as greatest, 0 without edges."""
    stored, missing = edges.agg(F.count("*"), F.count_if(F.isnan("score"))).first()
    if not stored:
        return 0.0
    e = min(max(int(nodes * (nodes - 1) // 2 * percent / 100), 1), stored)
    return float("nan") if e <= missing else ranked_values(edges.where(~F.isnan("score")), "score", [stored - e])[0]


def statistics(edges: DataFrame, thresholds: list[float]) -> DataFrame:
    """One pass: count, least, greatest, mean, and how many edges reach each threshold."""
    t = F.explode(F.array(*(F.struct(F.lit(float(x)).alias("threshold"), F.col(f"_{k}").alias("kept")) for k, x in enumerate(thresholds))))
    s = F.col("score")
    row = edges.where(~F.isnan("score")).agg(F.count("*").alias("edges"), F.min(s).alias("least"), F.max(s).alias("greatest"), F.avg(s).alias("mean"), *(F.count_if(s >= F.lit(float(x))).alias(f"_{k}") for k, x in enumerate(thresholds)))
    return row.select("edges", "least", "greatest", "mean", t.alias("t")).select("edges", "least", "greatest", "mean", "t.*")


def report_thresholds(least: float, greatest: float, blast: bool, limit: int = 200) -> list[float]:
    """Thresholds of a report: whole numbers to 100, then every 5 (hits), or tenths; over ``limit`` a step of 1, 2 or 5 times a power of ten."""
    import math

    if blast:
        low, high = math.floor(least), math.ceil(greatest)
        out = [float(x) for x in range(low, min(high, 100) + 1)] + [float(x) for x in range(105, high + 1, 5)]
    else:
        out = [round(x / 10, 1) for x in range(math.floor(least * 10), math.ceil(greatest * 10) + 1)]
    if len(out) <= limit:
        return out
    width = (greatest - least) / limit
    power = 10.0 ** math.floor(math.log10(width))
    step = next(m * power for m in (1, 2, 5, 10) if m * power >= width)
    return [round(x * step, 10) for x in range(math.floor(least / step), math.ceil(greatest / step) + 1)]


def quantile_values(rows: DataFrame, column: str, fractions: list[float]) -> list[float]:
    """Exact quantiles with linear interpolation of a column's finite and infinite values; NaN and nulls left out, none without values."""
    own = rows.where(F.col(column).isNotNull() & ~F.isnan(column)).select(column)
    n = own.count()
    if not n:
        return []
    at = [f * (n - 1) for f in fractions]
    values = ranked_values(own, column, [int(p) for p in at] + [min(int(p) + 1, n - 1) for p in at])
    return [a + (b - a) * (p - int(p)) for a, b, p in zip(values, values[len(at) :], at, strict=False)]


def quantiles(edges: DataFrame, percents: list[float], score: str = "score") -> DataFrame:
    """Exact quantiles with linear interpolation; NaN left out."""
    values = quantile_values(edges, score, [p / 100 for p in percents])
    return edges.sparkSession.createDataFrame(list(zip(map(float, percents), values, strict=False)), "percent double, value double")


def equal_bands(rows: DataFrame, column: str, bands: int) -> DataFrame:
    """``(band, n, low, high)``: the ends of ``bands`` stretches of the ordered values that differ by one row at most, as ntile deals them."""
    n = rows.count()
    sizes = [n // bands + (k < n % bands) for k in range(bands)]
    ends = [(k, int(sum(sizes[:k])), size) for k, size in enumerate(sizes) if size]
    values = ranked_values(rows, column, [s for _, s, _ in ends] + [s + size - 1 for _, s, size in ends]) if ends else []
    out = [(k + 1, size, a, b) for (k, _, size), a, b in zip(ends, values, values[len(ends) :], strict=False)]
    return rows.sparkSession.createDataFrame(out, "band int, n long, low double, high double")


#: A calibration sample: its share of the pairs below the cut, the least and most of them, bands and seed.
SAMPLE_SHARE, SAMPLE_LEAST, SAMPLE_MOST, SAMPLE_BANDS, SAMPLE_SEED = 0.01, 2000, 50_000, 20, 42


def calibration_sample(pairs: DataFrame, threshold: float, size: int | None = None, bands: int = SAMPLE_BANDS, counted: Counts | None = None) -> DataFrame:
    """``(i, j, score, weight)``: pairs below a similarity, as many from each of ``bands`` bands of equal count, by a hash with a fixed seed; the weight is the band's count over those drawn.

    Bands end at quantiles, as a range [low, high); all pairs are taken, with weight 1, where there are
    no more than ``size``, which is a share of them by default.  With the values ``counted`` the pairs
    are read once, for the draw.
    """
    skipped = pairs.where(F.col("score") < threshold).select("i", "j", "score")
    known = counted.below(threshold) if counted else None
    n = known.total if known else skipped.count()
    size = min(min(max(round(SAMPLE_SHARE * n), SAMPLE_LEAST), SAMPLE_MOST) if size is None else size, n)
    if size == n:
        return skipped.withColumn("weight", F.lit(1.0))
    fractions = [k / bands for k in range(bands + 1)]
    edges = known.quantiles(fractions) if known else quantile_values(skipped, "score", fractions)
    band = F.least(F.size(F.filter(F.array(*(F.lit(x) for x in edges[1:])), lambda e: e <= F.col("score"))), F.lit(bands - 1))
    placed = skipped.withColumn("band", band)
    if known:
        members = np.bincount(np.minimum(np.searchsorted(edges[1:], known.values, side="right"), bands - 1), known.n, bands)
        counts = {b: int(c) for b, c in enumerate(members) if c}
    else:
        counts = {r["band"]: r["n"] for r in placed.groupBy("band").agg(F.count("*").alias("n")).collect()}
    rows = [(b, min(size // bands + (b < size % bands), c), c) for b, c in counts.items()]
    takes = pairs.sparkSession.createDataFrame(rows, "band int, take long, members long")
    # A band's first rows by hash: those under a limit that leaves some more than are taken, then ranked.
    mark = F.pmod(F.xxhash64(F.lit(SAMPLE_SEED), "i", "j"), F.lit(1 << 40))
    limit = (F.col("take") + 8 * F.sqrt(F.col("take").cast("double")) + 64) / F.col("members")
    most = max((take + 8 * take**0.5 + 64) / members for _, take, members in rows)
    low = skipped.withColumn("mark", mark).where(F.col("mark") < F.lit(min(int(most * (1 << 40)) + 1, 1 << 40)))  # bands are looked up for few rows
    near = low.withColumn("band", band).join(F.broadcast(takes), "band").where(F.col("mark") < limit * (1 << 40))
    rank = F.row_number().over(Window.partitionBy("band").orderBy("mark", "i", "j"))
    return near.withColumn("rank", rank).where(F.col("rank") <= F.col("take")).select("i", "j", "score", (F.col("members") / F.col("take")).alias("weight"))


def locate_pairs(sample: DataFrame, edges: DataFrame, pos: str = "pos") -> DataFrame:
    """``(i, j, pos)`` of sampled pairs: the first position of an edge between them in either direction, -1 without one."""
    key = lambda d, *more: d.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), *more)
    first = key(edges, pos).groupBy("i", "j").agg(F.min(pos).alias(pos))
    return key(sample).join(first, ["i", "j"], "left").select("i", "j", F.coalesce(F.when(F.col("i") != F.col("j"), F.col(pos)), F.lit(-1)).alias(pos))


def condensed_index(i: Column, j: Column, n: int) -> Column:
    """Place of a pair in the row-major upper triangle of an n x n matrix."""
    low, high = F.least(i, j).cast("long"), F.greatest(i, j).cast("long")
    return F.shiftright(low * (F.lit(2 * n).cast("long") - low - 1), 1) + high - low - 1


def condensed_pair(place: Column, n: int) -> tuple[Column, Column]:
    """The pair (i, j), i < j, at a place of the upper triangle; the square root is corrected by a step either way."""
    odd = F.lit(2 * n - 1).cast("long")  # its square exceeds an int from n = 23,171 on
    start = lambda r: F.shiftright(r * (odd - r), 1)
    guess = F.greatest(F.least(F.floor((odd - F.sqrt((odd * odd - 8 * place).cast("double"))) / 2).cast("long"), F.lit(n - 2).cast("long")), F.lit(0).cast("long"))
    down = guess - (start(guess) > place).cast("long")
    i = down + (start(down + 1) <= place).cast("long")
    return i, place - start(i) + i + 1


def histogram(values: DataFrame, column: str, bins: int = 20, weight: str | None = None) -> DataFrame:
    """Equal-width bins, the last one closed; a constant column spreads over value -0.5 .. +0.5.  A row counts ``weight`` times."""
    v = values.where(F.col(column).isNotNull() & ~F.isnan(column))
    low, high = v.agg(F.min(column), F.max(column)).first()
    if low is None:
        return values.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    low, high = (low - 0.5, high + 0.5) if low == high else (float(low), float(high))
    b = F.least(F.width_bucket(F.col(column).cast("double"), F.lit(low), F.lit(high), F.lit(bins).cast("long")), F.lit(bins))
    counted = v.groupBy((b - 1).cast("int").alias("bin")).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    frame = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    width = (high - low) / bins
    return frame.join(F.broadcast(counted), "bin", "left").select("bin", (F.lit(low) + F.col("bin") * width).alias("low"), (F.lit(low) + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def subnetwork(edges: DataFrame, nodes: DataFrame, kept: DataFrame, node: str = "node") -> tuple[DataFrame, DataFrame]:
    """Edges with both ends in ``kept``, ends renumbered densely in node order: ``(nodes, edges)``."""
    own = nodes.join(kept.select(node).distinct(), node, "left_semi").select(node)
    numbered = dense_numbers(own, node)
    a = numbered.select(F.col(node).alias("i"), F.col("number").alias("ni"))
    b = numbered.select(F.col(node).alias("j"), F.col("number").alias("nj"))
    return numbered, edges.join(a, "i").join(b, "j").select(F.col("ni").alias("i"), F.col("nj").alias("j"), "score")


def dense_numbers(rows: DataFrame, key: str, per_block: int = 100_000) -> DataFrame:
    """``number``: 0, 1, .. in key order, without gathering all rows in one task."""
    n = rows.count()
    blocks = max(1, -(-n // per_block))
    cuts = rows.agg(F.percentile_approx(key, [k / blocks for k in range(1, blocks)], 10 * blocks)).first()[0] if blocks > 1 else []
    place = F.size(F.filter(F.array(*(F.lit(c) for c in sorted(set(cuts)))), lambda c: c < F.col(key))) if cuts else F.lit(0)
    placed = rows.withColumn("_block", place)
    counts = placed.groupBy("_block").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("_block").orderBy(key))
    return placed.withColumn("_r", within).join(F.broadcast(before), "_block").withColumn("number", F.col("_before") + F.col("_r") - 1).drop("_block", "_before", "_r")


def pending_pairs(required: DataFrame, done: DataFrame) -> DataFrame:
    """Required pairs that are not done yet, in either order of their ends."""
    key = lambda d: d.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).where("i <> j").distinct()
    return key(required).join(key(done), ["i", "j"], "left_anti")


def inject(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored pairs stay; new pairs are added where they were missing."""
    fresh = reduce_max(new)
    return old.select("i", "j", "score").unionByName(fresh.join(old.select("i", "j"), ["i", "j"], "left_anti"))


def scores_to_node(edges: DataFrame, node: int) -> DataFrame:
    """Best score of every other node's pair with one node."""
    near = edges.where(((F.col("i") == node) | (F.col("j") == node)) & (F.col("i") != F.col("j")))
    return near.groupBy(F.when(F.col("i") == node, F.col("j")).otherwise(F.col("i")).alias("node")).agg(F.max("score").alias("score"))


def neighbours(edges: DataFrame, selected: DataFrame) -> DataFrame:
    """Nodes next to a set, the set left out."""
    out = both_ways(edges).join(selected.select(F.col("node")), "node", "left_semi").select(F.col("other").alias("node")).distinct()
    return out.join(selected.select("node"), "node", "left_anti")
