"""Node metadata: merging files, summaries, profiles, paging, groups, colours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.operators.edges import quantile_values


def merge(nodes: DataFrame, rows: DataFrame, header: str, values: dict[str, str], order: str) -> DataFrame:
    """Left join of uploaded rows by exact header; blanks never overwrite, the last row with a value wins."""
    typed = rows.select(header, order, *(F.col(c).try_cast("double" if t == "number" else "string").alias(c) for c, t in values.items()))
    filled = lambda c: F.col(c).isNotNull() & ((F.col(c) != "") if values[c] == "text" else ~F.isnan(c))
    last = typed.groupBy(header).agg(*(F.max_by(c, F.when(filled(c), F.col(order))).alias(f"_{c}") for c in values))
    out = nodes.join(last, header, "left")
    for c in values:
        out = out.withColumn(c, F.coalesce(f"_{c}", c) if c in nodes.columns else F.col(f"_{c}")).drop(f"_{c}")
    return out


def describe_fields(rows: DataFrame, numbers: list[str], texts: list[str]) -> DataFrame:
    """Valid, missing and invalid counts of every field in one pass; infinite numbers are invalid."""
    parts = []
    for c in numbers:
        v = F.col(c).cast("double")
        bad = F.abs(v) == F.lit(float("inf"))
        parts.append((c, "number", F.count_if(v.isNotNull() & ~F.isnan(v) & ~bad), F.count_if(v.isNull() | F.isnan(v)), F.count_if(bad)))
    for c in texts:
        full = F.coalesce(F.col(c), F.lit("")) != ""
        parts.append((c, "text", F.count_if(full), F.count_if(~full), F.lit(0).cast("long")))
    row = rows.agg(*(x.alias(f"_{k}_{n}") for k, p in enumerate(parts) for n, x in enumerate(p[2:])))
    each = F.array(*(F.struct(F.lit(p[0]).alias("field"), F.lit(p[1]).alias("type"), *(F.col(f"_{k}_{n}").cast("long").alias(a) for n, a in enumerate(("valid", "missing", "invalid")))) for k, p in enumerate(parts)))
    return row.select(F.explode(each).alias("f")).select("f.*")


def numeric_summary(rows: DataFrame, column: str) -> DataFrame:
    """Valid, missing and invalid (infinite) counts and quartiles of a number."""
    v = F.col(column).cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    row = rows.agg(F.count_if(ok).alias("valid"), F.count_if(v.isNull() | F.isnan(v)).alias("missing"), F.count_if(F.abs(v) == float("inf")).alias("invalid"))
    q = quantile_values(rows.where(ok).select(v.alias("v")), "v", [0.0, 0.25, 0.5, 0.75, 1.0]) or [None] * 5
    return row.select("*", *(F.lit(x).cast("double").alias(n) for x, n in zip(q, ("least", "q1", "median", "q3", "greatest"), strict=True)))


def category_summary(rows: DataFrame, column: str, top: int = 10) -> DataFrame:
    """The most frequent values by count, then value, and the count of all others."""
    counted = rows.where(F.coalesce(F.col(column), F.lit("")) != "").groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    best = counted.orderBy(F.col("n").desc(), "value").limit(top)
    rest = counted.join(F.broadcast(best.select("value")), "value", "left_anti").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return best.unionByName(rest.select(F.lit("(other)").alias("value"), "n"))


def membership_counts(rows: DataFrame, groups: str) -> DataFrame:
    """Nodes per group of a multi-valued column."""
    return rows.select(F.explode(groups).alias("group")).groupBy("group").agg(F.count("*").alias("n"))


def assign(groups: Column, names: list[str]) -> Column:
    return F.array_sort(F.array_union(F.coalesce(groups, F.array().cast("array<string>")), F.array(*(F.lit(n) for n in names))))


def unassign(groups: Column, names: list[str]) -> Column:
    return F.array_except(groups, F.array(*(F.lit(n) for n in names)))


def page(rows: DataFrame, key: str, after: int | None, limit: int) -> DataFrame:
    """A page in key order after a cursor; limit 1 to 500."""
    if not 1 <= limit <= 500:
        raise ValueError("a page has 1 to 500 rows")
    return (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(limit)


def spectrum(rows: DataFrame, column: str) -> DataFrame:
    """``shade``: min-max scale of the finite values, 0.5 where all are equal, null where missing."""
    v = F.col(column).cast("double")
    ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    ends = rows.agg(F.min(F.when(ok, v)).alias("_lo"), F.max(F.when(ok, v)).alias("_hi"))
    out = rows.join(F.broadcast(ends))
    return out.withColumn("shade", F.when(ok, F.when(F.col("_hi") == F.col("_lo"), 0.5).otherwise((v - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))))).drop("_lo", "_hi")


def format_value(value: Column) -> Column:
    """Whole numbers without a decimal point."""
    return F.when(value == F.floor(value), value.cast("bigint").cast("string")).otherwise(value.cast("string"))


def significant(value: Column, digits: int) -> Column:
    """Rounded to significant digits; null where not finite."""
    power = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(value))))
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).when(value == 0, 0.0).otherwise(F.round(value * power) / power)


def thin(rows: DataFrame, order: str, every: int) -> DataFrame:
    """Every k-th row of a stable order given by a dense number."""
    return rows.where(F.col(order) % every == 0)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def order_categories(counted: DataFrame, value: str, n: str = "n") -> DataFrame:
    """``rank`` by falling count, then value."""
    return counted.withColumn("rank", F.row_number().over(Window.orderBy(F.col(n).desc(), F.col(value).asc())))
