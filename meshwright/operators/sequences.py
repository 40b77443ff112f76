"""Sequence records: cleaning, duplicates, names, manifests, derived columns, residue codes, crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Residues, average masses (Da) of the free amino acids and of water, hydropathy, and pKa of ionisable
# groups; ambiguity codes and what they stand for.
STANDARD = "ACDEFGHIKLMNPQRSTVWY"
EXTENDED = STANDARD + "BZJXUO"
WATER = 18.0153
FREE_MASS = {
    "A": 89.0932, "C": 121.1582, "D": 133.1027, "E": 147.1293, "F": 165.1891, "G": 75.0666, "H": 155.1546, "I": 131.1729,
    "K": 146.1876, "L": 131.1729, "M": 149.2113, "N": 132.1179, "O": 255.3134, "P": 115.1305, "Q": 146.1445, "R": 174.2010,
    "S": 105.0926, "T": 119.1192, "U": 168.0532, "V": 117.1463, "W": 204.2252, "Y": 181.1885,
}
HYDROPATHY = {"A": 1.8, "C": 2.5, "D": -3.5, "E": -3.5, "F": 2.8, "G": -0.4, "H": -3.2, "I": 4.5, "K": -3.9, "L": 3.8, "M": 1.9, "N": -3.5, "P": -1.6, "Q": -3.5, "R": -4.5, "S": -0.8, "T": -0.7, "V": 4.2, "W": -0.9, "Y": -1.3}
POSITIVE = {"K": 10.0, "R": 12.0, "H": 5.98}
NEGATIVE = {"D": 4.05, "E": 4.45, "C": 9.0, "Y": 10.0}
N_TERMINUS = {"A": 7.59, "M": 7.0, "S": 6.93, "P": 8.36, "T": 6.82, "V": 7.44, "E": 7.7}
C_TERMINUS = {"D": 4.55, "E": 4.75}
N_OTHER, C_OTHER = 7.5, 3.55
AMBIGUOUS = {"B": "DN", "Z": "EQ", "J": "LI", "X": STANDARD}


def clean_header(h: Column) -> Column:
    """Brackets to parentheses, reserved signs and white space to one underscore."""
    out = F.translate(h, "[]{}", "()()")
    out = F.regexp_replace(F.regexp_replace(F.trim(out), r'[?*"#%@$/\\]', "_"), r"\s+", "_")
    return F.regexp_replace(out, "_+", "_")


def clean_sequence(s: Column) -> Column:
    """Upper case, trimmed to the first and last residue, X for anything else between."""
    trimmed = F.regexp_extract(F.upper(s), f"(?s)[{EXTENDED}](?:.*[{EXTENDED}])?", 0)
    return F.regexp_replace(trimmed, f"[^{EXTENDED}]", "X")


def dedup(records: DataFrame, header: str = "header", seq: str = "seq") -> DataFrame:
    """One row per sequence under its longest header (ties: the least), with the number merged."""
    return records.groupBy(seq).agg(F.min_by(header, F.struct(-F.length(header), F.col(header))).alias(header), F.count("*").alias("merged"))


def numbered_within(rows: DataFrame, key: str, pos: str, out: str, per_block: int = 10_000) -> DataFrame:
    """``out``: 1, 2, .. per ``key`` in order of the whole number ``pos``; a key's rows are numbered in blocks of positions, never in one task."""
    placed = rows.withColumn("_block", F.floor(F.col(pos) / F.lit(per_block)))
    counts = placed.groupBy(key, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(key, "_block").orderBy(pos))
    return placed.withColumn("_r", within).join(offsets, [key, "_block"]).withColumn(out, F.col("_before") + F.col("_r")).drop("_block", "_before", "_r")


def unique_headers(records: DataFrame, header: str = "header", seq: str = "seq", pos: str = "pos") -> DataFrame:
    """Names of distinct records ``(header, seq, pos)``: a header of one sequence stays, those of several get _1, _2, .. in order of ``pos``.

    Numbers that would make the name of another header are skipped; a header that ends in an
    underscore gets no second one, so that it shares its numbers with the header without it, the
    one that comes first counting first.  The k-th free number is k plus the taken ones before it.
    """
    prefix = F.when(F.col(header).endswith("_"), F.col(header)).otherwise(F.concat(header, F.lit("_")))
    heads = records.groupBy(header).agg(F.count("*").alias("_n"), F.min(pos).alias("_first")).withColumn("_prefix", prefix)
    mine = F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)
    earlier = Window.partitionBy("_prefix").orderBy("_first", header).rowsBetween(Window.unboundedPreceding, -1)  # two rows at most
    heads = heads.withColumn("_skip", F.coalesce(F.sum(mine).over(earlier), F.lit(0)))
    number = F.regexp_extract(header, "(?s)^.*_([1-9][0-9]{0,17})$", 1)
    taken = heads.where(number != "").select(F.regexp_extract(header, "(?s)^(.*_)[1-9][0-9]{0,17}$", 1).alias("_prefix"), number.cast("long").alias("_t"))
    taken = taken.groupBy("_prefix").agg(F.transform(F.array_sort(F.collect_set("_t")), lambda t, i: t - i - 1).alias("_gaps"))  # free numbers before each taken one
    heads = heads.join(taken, "_prefix", "left")
    own = numbered_within(records, header, pos, "_k").join(heads, header)
    k = F.col("_skip") + F.col("_k")
    free = k + F.coalesce(F.size(F.filter("_gaps", lambda g: g < k)), F.lit(0))
    name = F.when(F.col("_n") == 1, F.col(header)).otherwise(F.concat("_prefix", free.cast("string")))
    return own.select(F.col(header).alias("original"), name.alias(header), seq, pos)


def sanitize_records(records: DataFrame, header: str = "header", seq: str = "seq", pos: str = "pos") -> DataFrame:
    """Cleaned records under unique headers: ``(original, header, seq, pos, merged)`` in order of ``pos``, the first of each sequence; empty sequences go."""
    clean = records.select(clean_header(F.col(header)).alias(header), clean_sequence(F.col(seq)).alias(seq), pos).where(F.col(seq) != "")
    best = clean.groupBy(seq).agg(F.min_by(header, F.struct(-F.length(header), F.col(header))).alias(header), F.min(pos).alias(pos), F.count("*").alias("merged"))
    return unique_headers(best, header, seq, pos).join(best.select(pos, "merged"), pos).select("original", header, seq, pos, "merged")


def sanitize_report(records: DataFrame, header: str = "header", seq: str = "seq", pos: str = "pos") -> DataFrame:
    """Counts of what ``sanitize_records`` changes, in one row."""
    raw = records.agg(
        F.count("*").alias("original"),
        F.count_if(clean_header(F.col(header)) != F.col(header)).alias("headers_modified"),
        F.count_if(clean_sequence(F.col(seq)) != F.col(seq)).alias("sequences_modified"),
        F.count_if(clean_sequence(F.col(seq)) == "").alias("empty_removed"),
    )
    out = sanitize_records(records, header, seq, pos).agg(F.count("*").alias("final"), F.count_if(F.col("original") != F.col(header)).alias("headers_renamed"))
    return raw.join(F.broadcast(out))


def header_manifest(records: DataFrame, header: str = "header", seq: str = "seq", pos: str = "pos") -> DataFrame:
    """``(node, header, raw, first_word, length)``: nodes 0, 1, .. in order of ``pos`` under their cleaned headers; first_word only of headers with several words.

    Repeated raw headers, distinct ones that clean alike, headers that clean to nothing and records
    without a sequence are errors, told by name.
    """
    from meshwright.operators.edges import dense_numbers

    own = records.select(F.col(header).alias("raw"), clean_header(F.col(header)).alias("header"), F.length(seq).alias("length"), F.col(pos).alias("pos"))
    same = own.groupBy("header").agg(F.count("*").alias("n"), F.min("raw").alias("raw"), F.countDistinct("raw").alias("kinds"))
    for fault, rows in (
        ("repeated header", same.where("n > kinds")),
        ("headers that clean alike", same.where("kinds > 1")),
        ("header empty after cleaning", own.where("header = ''")),
        ("record without a sequence", own.where("coalesce(length, 0) = 0")),
    ):
        if found := rows.select("raw").limit(3).collect():
            raise ValueError(f"{fault}: {', '.join(repr(r['raw']) for r in found)}")
    words = F.split(F.trim("raw"), r"\s+")
    first = F.when(F.size(words) > 1, clean_header(words[0]))
    return dense_numbers(own, "pos").select(F.col("number").alias("node"), "header", "raw", first.alias("first_word"), "length")


def short_label(h: Column) -> Column:
    """An accession, else the field after ``|gb|``, else the first word."""
    accession = F.regexp_extract(h, r"\b([OPQ][0-9][A-Z0-9]{3}[0-9]|[A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2})\b", 1)
    gb = F.regexp_extract(h, r"\|gb\|([^|]+)", 1)
    return F.when(accession != "", accession).when(gb != "", gb).otherwise(F.regexp_extract(h, r"^\s*(\S*)", 1))


def _count(s: Column, letter: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(letter), F.lit("")))


def _with_ambiguous(table: dict[str, float], codes: str) -> dict[str, float]:
    """``table`` and the means of what ambiguity codes stand for."""
    return table | {c: sum(table[r] for r in AMBIGUOUS[c]) / len(AMBIGUOUS[c]) for c in codes}


def kilodaltons(s: Column) -> Column:
    """Mass in kDa: residues (free masses less water each) and one water; ambiguity codes weigh the mean of what they stand for."""
    table = _with_ambiguous({a: m - WATER for a, m in FREE_MASS.items()}, "BZJX")
    total = sum((_count(s, a) * m for a, m in table.items()), F.lit(WATER))
    return F.when(F.length(s) > 0, total / 1000)


def gravy(s: Column) -> Column:
    """Mean hydropathy; B, Z and J as the means of what they stand for, others left out."""
    table = _with_ambiguous(HYDROPATHY, "BZJ")
    n = sum((_count(s, a) for a in table), F.lit(0))
    return F.when(n > 0, sum((_count(s, a) * h for a, h in table.items()), F.lit(0.0)) / n)


def isoelectric_point(s: Column) -> Column:
    """Midpoint after 17 bisections of the charge curve on [4.05, 12]."""
    first, last = F.substring(s, 1, 1), F.substring(s, -1, 1)
    pick = lambda c, table, other: F.coalesce(F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v))))[c], F.lit(other))
    counts = F.struct(*(_count(s, a).alias(a) for a in [*POSITIVE, *NEGATIVE, "B", "Z"]), pick(first, N_TERMINUS, N_OTHER).alias("first"), pick(last, C_TERMINUS, C_OTHER).alias("last"))

    def solve(k: Column) -> Column:
        plus = lambda pka, ph: 1 / (1 + F.pow(F.lit(10.0), ph - pka))
        minus = lambda pka, ph: 1 / (1 + F.pow(F.lit(10.0), pka - ph))

        def charge(ph: Column) -> Column:
            up = plus(k["first"], ph) + sum((k[a] * plus(F.lit(p), ph) for a, p in POSITIVE.items()), F.lit(0.0))
            down = minus(k["last"], ph) + sum(((k[a] + k[h] * 0.5 if h else k[a]) * minus(F.lit(NEGATIVE[a]), ph) for a, h in (("D", "B"), ("E", "Z"), ("C", ""), ("Y", ""))), F.lit(0.0))
            return up - down

        def halve(acc: Column, _: Column) -> Column:
            mid = (acc["lo"] + acc["hi"]) / 2
            return F.when(charge(mid) > 0, F.struct(mid.alias("lo"), acc["hi"].alias("hi"))).otherwise(F.struct(acc["lo"].alias("lo"), mid.alias("hi")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(17)), F.struct(F.lit(4.05).alias("lo"), F.lit(12.0).alias("hi")), halve, lambda a: (a["lo"] + a["hi"]) / 2)

    return F.when(F.length(s) > 0, F.transform(F.array(counts), solve)[0])


def residue_codes(s: Column) -> Column:
    """Array of 0..19 for standard residues in either case, -1 for all other signs."""
    return F.transform(F.split(F.upper(s), ""), lambda c: F.instr(F.lit(STANDARD), c) - 1)


def crop_offsets(full: DataFrame, crops: DataFrame, on: str, seq: str = "seq", crop: str = "crop") -> DataFrame:
    """Offset (from 0) of the first occurrence of each crop in its record's sequence, -1 if missing, and whether it recurs."""
    at = F.instr(F.col(seq), F.col(crop))
    again = F.contains(F.substring(F.col(seq), at + 1, F.length(seq)), F.col(crop))
    return full.join(crops, on).select(on, (at - 1).alias("offset"), (again & (at > 0)).alias("ambiguous"))


def crop_embeddings(store: DataFrame, crops: DataFrame, header: str = "header", seq: str = "seq", embedding: str = "embedding") -> DataFrame:
    """Records of ``crops (header, seq)`` with the part of the stored residue array that their sequence is: ``(header, seq, embedding, status)``; status is found, ambiguous (the first place counts), not_found or missing."""
    stored = store.select(header, F.col(seq).alias("_full"), F.col(embedding).alias("_whole"))
    both = crops.select(header, seq).join(stored, header, "left")
    at = F.instr("_full", F.col(seq))
    again = F.contains(F.substring("_full", at + F.length(seq), F.length("_full")), F.col(seq))
    status = F.when(F.col("_full").isNull(), "missing").when(at == 0, "not_found").when(again, "ambiguous").otherwise("found")
    return both.select(header, seq, F.when(at > 0, F.slice("_whole", at, F.length(seq))).alias(embedding), status.alias("status"))


def extract_embeddings(store: DataFrame, wanted: DataFrame, header: str = "header", seq: str = "seq") -> DataFrame:
    """Stored records of ``wanted (header[, seq])``; a sequence that differs from the stored one is an error, a header that is not stored is left out."""
    if seq not in wanted.columns:
        return store.join(wanted.select(header).distinct(), header, "left_semi")
    other = wanted.select(header, F.col(seq).alias("_wanted")).distinct()
    same = F.when(F.col(seq) == F.col("_wanted"), True).otherwise(F.raise_error(F.concat(F.lit("another sequence is stored under "), F.col(header))).cast("boolean"))
    return store.join(other, header).where(same).drop("_wanted")


def length_statistics(records: DataFrame, seq: str = "seq") -> DataFrame:
    from meshwright.operators.edges import quantile_values

    n = F.length(seq)
    median = quantile_values(records.select(n.cast("double").alias("n")), "n", [0.5]) or [None]
    return records.agg(F.count(seq).alias("n"), F.min(n).alias("least"), F.lit(median[0]).cast("double").alias("median"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("sd"), F.max(n).alias("greatest"))


def length_histogram(records: DataFrame, seq: str = "seq", most: int = 50) -> DataFrame:
    """Equal-width bins of the lengths, one per length up to ``most`` bins."""
    from meshwright.operators.edges import histogram

    lengths = records.select(F.length(seq).alias("length"))
    low, high = lengths.agg(F.min("length"), F.max("length")).first()
    return histogram(lengths, "length", 1 if low is None else max(1, min(most, high - low + 1)))


def keep(records: DataFrame, without: str | None, least: int, most: int, header: str = "header", seq: str = "seq") -> DataFrame:
    """Records without a case-sensitive header part and of a length in range."""
    out = records.where(F.length(seq).between(least, most))
    return out if not without else out.where(~F.contains(F.col(header), F.lit(without)))


def keep_named(nodes: DataFrame, names: DataFrame, header: str = "header") -> DataFrame:
    """Nodes whose whole header is one of ``names``, or whose first word is the first word of one."""
    word = lambda c: F.split(F.trim(c), r"\s+")[0]
    whole = nodes.join(names.select(header).distinct(), header, "left_semi").select(header)
    first = nodes.withColumn("_word", word(header)).join(names.select(word(header).alias("_word")).distinct(), "_word", "left_semi").select(header)
    return nodes.join(whole.unionByName(first).distinct(), header, "left_semi")


def reference_matches(headers: DataFrame, target: str, header: str = "header", pos: str = "pos") -> DataFrame:
    """The first match of the best tier: exact, leading identifier, then part or wildcard."""
    from meshwright.functions.predicate import glob_pattern

    h, low = F.lower(header), target.lower()
    tier = F.when(h == low, 1).when(h.startswith(low + "_") | h.startswith(low + "|"), 2)
    tier = tier.when(h.rlike(glob_pattern(low)) if any(c in low for c in "*?[") else h.contains(low), 3)
    return headers.withColumn("tier", tier).where("tier is not null").orderBy("tier", pos).limit(1)


def manifest_digest(records: DataFrame, header: str = "header", seq: str = "seq", pos: str = "pos", per_block: int = 10_000) -> DataFrame:
    """SHA-256 over record digests in order, folded by blocks so that no task holds all records."""
    rows = records.select((F.col(pos) / per_block).cast("long").alias("b"), F.col(pos).alias("p"), F.sha2(F.concat_ws("\n", header, seq), 256).alias("d"))
    fold = lambda key, value: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), ""), 256)
    blocks = rows.groupBy("b").agg(fold("p", "d").alias("d"))
    return blocks.agg(fold("b", "d").alias("sha256"))
