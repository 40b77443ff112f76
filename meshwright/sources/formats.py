"""Scans and sinks: FASTA, alignments, tabular hits, networks, embedding stores, metadata tables, header lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.operators.sequences import EXTENDED, clean_header, sanitize_records

HITS = "query string, subject string, pident double, length int, mismatch int, gapopen int, qstart int, qend int, sstart int, send int, evalue double, bitscore double"
#: Columns that a network of each kind has.
NETWORKS = {"blast": ["i", "j", "score"], "alignment": ["i", "j", "l_score", "l_len", "g_score", "g_len"]}
SCORE_KINDS = ("evalue", "efi_alignment_score")


def in_file_order(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """Add ``pos``: 0, 1, .. over the rows of a file scan, in order of file name and place in the file.

    A scan reads a stretch of a file in order; only the stretches, a row for each, are put in order.
    """
    row = F.monotonically_increasing_id()
    own = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), row.alias("_row"))
    parts = own.groupBy("_file", "_at").agg(F.min("_row").alias("_first"), F.max("_row").alias("_last"))
    before = F.sum(F.col("_last") - F.col("_first") + 1).over(Window.orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_last")
    return own.join(parts, ["_file", "_at"]).withColumn(pos, F.col("_before") + F.col("_row") - F.col("_first")).drop("_file", "_at", "_row", "_first", "_before")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(header, seq, pos)``, pos in file order; records are split at ``>`` by the scan, so that large files are read in parallel."""
    raw = in_file_order(spark.read.option("lineSep", "\n>").text(path))
    record = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^﻿?>?", "")
    parts = F.split(record, "\n", 2)
    return raw.where(F.trim(F.regexp_replace("value", "^﻿?>?", "")) != "").select(F.trim(parts[0]).alias("header"), F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", "").alias("seq"), "pos")


def read_sanitized_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records of a FASTA file, cleaned, deduplicated and under unique headers."""
    return sanitize_records(read_fasta(spark, path))


def clean_aligned(seq: Column) -> Column:
    """An aligned sequence with every column kept: white space goes, points are gaps, other signs X."""
    plain = F.replace(F.upper(F.regexp_replace(seq, r"\s", "")), F.lit("."), F.lit("-"))
    return F.regexp_replace(plain, f"[^{EXTENDED}-]", "X")


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    """``(row, header, seq)`` of an aligned FASTA file; empty or repeated headers (also after cleaning), records without a sequence and unequal lengths are errors."""
    rows = read_fasta(spark, path).select(F.col("pos").alias("row"), clean_header(F.col("header")).alias("header"), F.col("header").alias("raw"), clean_aligned(F.col("seq")).alias("seq"))
    found = rows.agg(F.count("*").alias("n"), F.count_if(F.col("header") == "").alias("unnamed"), F.count_if(F.col("seq") == "").alias("empty"), F.min(F.length("seq")).alias("least"), F.max(F.length("seq")).alias("most")).first()
    twice = rows.groupBy("header").agg(F.count("*").alias("n")).where("n > 1").limit(3).collect()
    if not found["n"]:
        raise ValueError("the alignment has no records")
    if found["unnamed"] or found["empty"]:
        raise ValueError(f"{found['unnamed']} records without a header, {found['empty']} without a sequence")
    if twice:
        raise ValueError(f"repeated headers: {', '.join(r['header'] for r in twice)}")
    if found["least"] != found["most"]:
        raise ValueError(f"sequences of {found['least']} to {found['most']} columns")
    return rows.select("row", "header", "seq")


def write_fasta(records: DataFrame, path: str, header: str = "header", seq: str = "seq", order: str | None = None) -> None:
    """One record per row, sorted by ``order`` if given; Spark's commit protocol publishes all or nothing."""
    own = records if order is None else records.orderBy(order)
    own.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), F.col(seq)).alias("value")).write.text(path)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Twelve tab-separated columns; a malformed line fails the scan, comment lines are left out."""
    return spark.read.option("comment", "#").option("mode", "FAILFAST").csv(path, sep="\t", schema=HITS)


def read_custom_hits(spark: SparkSession, path: str, query: int, subject: int, score: int) -> DataFrame:
    """``(query, subject, value)`` of three columns, counted from 1, of tab-separated lines of one width; other widths and values that are not finite numbers from 0 on are errors."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("#")).select(F.split(F.regexp_replace("value", "\r$", ""), "\t", -1).alias("c"), "value")
    low, high = lines.agg(F.min(F.size("c")), F.max(F.size("c"))).first()
    if low != high:
        raise ValueError(f"lines of {low} to {high} columns")
    if low is not None and not all(1 <= k <= low for k in (query, subject, score)):
        raise ValueError(f"a column beyond the {low} of each line")
    value = F.col("c")[score - 1].try_cast("double")
    good = value.isNotNull() & ~F.isnan(value) & (value >= 0) & (value != float("inf"))
    told = F.when(good, value).otherwise(F.raise_error(F.concat(F.lit("no finite number from 0 on: "), F.col("c")[score - 1])).cast("double"))
    return lines.select(F.col("c")[query - 1].alias("query"), F.col("c")[subject - 1].alias("subject"), told.alias("value"))


def read_commented_hits(spark: SparkSession, path: str) -> DataFrame:
    """Hits whose columns a ``# Fields:`` comment names and whose query a ``# Query:`` comment gives: ``(file, query, row)``, row a map of fields.

    A block's comments govern the lines after them, so a file is one task's work; files are read in parallel.
    """
    schema = "file string, query string, row map<string,string>"

    def parse(frames):
        import pandas as pd

        for pdf in frames:
            out = []
            for file, text in zip(pdf["path"], pdf["text"], strict=True):
                fields, query = [], ""
                for number, line in enumerate(text.splitlines(), 1):
                    if line.startswith("# Fields:"):
                        fields = [f.strip() for f in line[9:].split(",")]
                    elif line.startswith("# Query:"):
                        query = line[8:].strip()
                    elif line and not line.startswith("#"):
                        cells = line.split("\t")
                        if len(cells) != len(fields):
                            raise ValueError(f"{file}, line {number}: {len(cells)} cells for {len(fields)} fields")
                        out.append((file, query, dict(zip(fields, cells, strict=True))))
            yield pd.DataFrame(out, columns=["file", "query", "row"])

    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return raw.mapInPandas(parse, schema)


def search_header(spark: SparkSession, path: str) -> DataFrame:
    """Program, version and command from the leading comments."""
    lines = spark.read.text(path).where(F.col("value").startswith("#")).limit(1000)
    pick = lambda p, g=1: F.max(F.when(F.col("value").rlike(p), F.regexp_extract("value", p, g)))
    return lines.agg(pick(r"^# (\S+) v?\d[\w.+]*").alias("program"), pick(r"^# \S+ v?(\d[\w.+]*)").alias("version"), pick(r"^# (?:Invocation|Command): (.*)").alias("command"))


def completeness(hits: DataFrame) -> DataFrame:
    """Whether a cap on targets seems to have cut a search short: ``(queries, largest, at_largest, exceeded, capped)``.

    Of the queries that report the most targets of any, at least 3 and a tenth are themselves reported
    by more queries than that.
    """
    pairs = hits.select("query", "subject").distinct()
    per = pairs.groupBy("query").agg(F.count("*").alias("n"))
    reported = pairs.groupBy(F.col("subject").alias("query")).agg(F.count("*").alias("by"))
    top = per.agg(F.count("*").alias("queries"), F.max("n").alias("largest"))
    at = per.join(F.broadcast(top), F.col("n") == F.col("largest")).join(reported, "query", "left")
    out = at.groupBy("queries", "largest").agg(F.count("*").alias("at_largest"), F.count_if(F.col("by") > F.col("largest")).alias("exceeded"))
    return out.withColumn("capped", (F.col("exceeded") >= 3) & (F.col("exceeded") >= 0.1 * F.col("at_largest")))


def network_of_hits(hits: DataFrame, manifest: DataFrame, score: Column | None = None) -> DataFrame:
    """Edges of hits between known headers ``(header, node[, length])``: best score per unordered pair; an unknown name is an error on use.

    The score is that of the E-value unless another is given, of the columns of ``hits`` and the
    lengths ``li`` and ``lj`` of both ends.
    """
    from meshwright.operators.edges import evalue_score, reduce_max

    def named(end: str, out: str) -> DataFrame:
        length = F.col("length") if "length" in manifest.columns else F.lit(None).cast("int")
        return manifest.select(F.col("header").alias(end), F.col("node").alias(out), length.alias(f"l{out}"))

    own = hits.withColumns({"query": clean_header(F.col("query")), "subject": clean_header(F.col("subject"))})
    joined = own.join(named("query", "i"), "query", "left").join(named("subject", "j"), "subject", "left")
    known = lambda c, n: F.when(F.col(c).isNull(), F.raise_error(F.concat(F.lit("not in the manifest: "), F.col(n)))).otherwise(F.col(c))
    value = evalue_score(F.col("evalue")) if score is None else score
    return reduce_max(joined.select(known("i", "query").alias("i"), known("j", "subject").alias("j"), value.alias("score")))


def network_kind(columns: list[str], model: str, score_kind: str | None = None, expected: str | None = None) -> str:
    """The kind of a network by the model that made it, blast or alignment; what its kind lacks is an error."""
    if not model.strip():
        raise ValueError("a network names its model")
    kind = "blast" if model.strip().casefold() == "blast" else "alignment"
    if expected not in (None, kind):
        raise ValueError(f"a network of kind {kind}, not {expected}")
    if kind == "blast" and (score_kind or SCORE_KINDS[0]).strip() not in SCORE_KINDS:
        raise ValueError(f"unknown score {score_kind!r}; known: {', '.join(SCORE_KINDS)}")
    if missing := [c for c in NETWORKS[kind] if c not in columns]:
        raise ValueError(f"a network of kind {kind} lacks {', '.join(missing)}")
    return kind


def read_network(spark: SparkSession, path: str, model: str, columns: list[str] | None = None) -> DataFrame:
    """The edges of a stored network of a kind, or those columns of them that a caller needs."""
    edges = spark.read.parquet(path)
    kind = network_kind(edges.columns, model)
    return edges.select(columns or NETWORKS[kind])


def network_completeness(edges: DataFrame, nodes: int) -> DataFrame:
    """``(nodes, edges, expected, status)``: complete with all pairs, incomplete with fewer, unknown with more."""
    expected = nodes * (nodes - 1) // 2
    n = F.col("edges")
    status = F.when(n == expected, "complete").when(n < expected, "incomplete").otherwise("unknown")
    return edges.agg(F.count("*").alias("edges")).select(F.lit(nodes).cast("long").alias("nodes"), "edges", F.lit(expected).cast("long").alias("expected"), status.alias("status"))


def check_embeddings(store: DataFrame) -> DataFrame:
    """``(header, fault)`` of stored records ``(header, seq, embedding)``: repeated or unsafe headers, sequences that are empty or not clean, other numbers of residues, widths that differ, values that are not finite."""
    widths = F.transform("embedding", lambda r: F.size(r))
    width = store.agg(F.min(F.array_min(widths)), F.max(F.array_max(widths))).first()
    finite = F.forall("embedding", lambda r: F.forall(r, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    fault = (
        F.when(F.coalesce(F.trim("header"), F.lit("")).isin("", ".", "..") | F.col("header").rlike(r"[/\\\x00]"), "unsafe header")
        .when(F.col("_n") > 1, "repeated header")
        .when(F.coalesce("seq", F.lit("")) == "", "no sequence")
        .when(F.col("seq").rlike(f"[^{EXTENDED}]"), "sequence not clean")
        .when(F.coalesce(F.size("embedding"), F.lit(-1)) != F.length("seq"), "other number of residues")
        .when(F.exists(widths, lambda w: w != F.lit(width[1])), "other width")
        .when(~finite, "values not finite")
    )
    counts = store.groupBy(F.col("header").alias("_header")).agg(F.count("*").alias("_n"))
    return store.join(counts, F.col("header").eqNullSafe(F.col("_header")), "left").select("header", fault.alias("fault")).where("fault is not null").distinct()


def match_sources(records: DataFrame, keys: DataFrame, id_map: DataFrame | None = None) -> DataFrame:
    """``(header, key, rule)``: the source of each record ``(header, original)`` among ``keys (key)`` by the first rule that finds one: the map ``(header, key)``, the whole original header, its first word, the cleaned header, a UniProt accession."""
    accession = F.regexp_extract("original", r"^(?:sp|tr)\|([^|]+)\|", 1)
    rules = [("header", F.col("original")), ("first_word", F.regexp_extract("original", r"^\s*(\S*)", 1)), ("sanitized_header", clean_header(F.col("original"))), ("accession", accession)]
    tried = F.array(*(F.struct(F.lit(k + 1).alias("rank"), F.lit(n).alias("rule"), v.alias("key")) for k, (n, v) in enumerate(rules)))
    each = records.select("header", F.explode(tried).alias("t")).select("header", "t.*")
    if id_map is not None:
        mapped = records.select("header", "original").join(id_map.select(F.col("header").alias("original"), "key"), "original").select("header", F.lit(0).alias("rank"), F.lit("map").alias("rule"), "key")
        each = each.unionByName(mapped)
    found = each.where("key <> ''").join(keys.select("key").distinct(), "key", "left_semi")
    best = found.groupBy("header").agg(F.min_by(F.struct("key", "rule"), F.struct("rank", "key")).alias("b"))
    return records.select("header").distinct().join(best, "header", "left").select("header", "b.key", "b.rule")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Rows under two header rows, names and types (number or text), of one file or all files of a folder; the first column is the header.

    Each file has its own header rows, and columns of its own may be missing in others.  ``order`` numbers
    the rows over the files in order of their names, as ``metadata.merge`` wants it.
    """
    files = sorted(r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect())
    parts = []
    for k, file in enumerate(files):
        raw = spark.read.csv(file, header=False)
        names, types = ([x or "" for x in r] for r in raw.limit(2).collect())
        if any(t.strip().lower() not in ("number", "num", "numerical", "text") for t in types[1:]):
            raise ValueError(f"{file}: the second row declares number or text for every column")
        body = in_file_order(raw, "_pos").where("_pos >= 2")
        cast = lambda c, t: F.col(f"_c{c}").try_cast("double") if t.strip().lower().startswith("num") else F.coalesce(f"_c{c}", F.lit(""))
        parts.append(body.select(F.col("_c0").alias("header"), (F.lit(k).cast("long") * (1 << 40) + F.col("_pos")).alias("order"), *(cast(c, types[c]).alias(names[c]) for c in range(1, len(names)))))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def metadata_table(rows: DataFrame, header: str, numbers: list[str], texts: list[str], everything: bool = False) -> DataFrame:
    """Rows as ``read_metadata`` reads them, two header rows first: whole numbers without a point, blanks for what is missing; rows without any value only with ``everything``."""
    from meshwright.operators.metadata import format_value

    number = lambda c: F.when(F.col(c).isNull() | F.isnan(c), "").otherwise(format_value(F.col(c)))
    text = lambda c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) == "", "").otherwise(F.col(c))
    cells = {**{c: number(c) for c in numbers}, **{c: text(c) for c in texts}}
    body = rows.select(F.lit(2).alias("_k"), F.col(header).alias("c0"), *(v.alias(f"c{k}") for k, v in enumerate(cells.values(), 1)))
    names = [f"c{k}" for k in range(len(cells) + 1)]
    if not everything:
        body = body.where(F.concat_ws("", *names[1:]) != "")
    head = [(0, "", *cells), (1, "", *("number" for _ in numbers), *("text" for _ in texts))]
    return rows.sparkSession.createDataFrame(head, ", ".join(["_k int", *(f"{n} string" for n in names)])).unionByName(body).orderBy("_k", "c0").select(*names)


def hit_report(hits: DataFrame, top_k: int = 20, least: float = 0.0, stored: bool = True) -> DataFrame:
    """The metadata report of a search: ``hits (header, score, norm_score, length, aligned, identical, similar[, is_query])`` ranked by normalised score, then header.

    Hits under ``least`` go; the query's own record goes where it is a stored one, which then takes
    one of ``top_k`` places (-1: no limit).  Percentages are over the aligned columns.
    """
    own = hits.where(F.col("norm_score") >= least)
    if stored and "is_query" in hits.columns:
        own = own.where(~F.col("is_query"))
    if top_k != -1:
        own = own.orderBy(F.col("norm_score").desc(), "header").limit(max(0, top_k - stored))
    rank = F.row_number().over(Window.orderBy(F.col("norm_score").desc(), "header"))
    share = lambda c: F.round(100 * F.col(c) / F.col("aligned"), 2)
    gaps = F.round(100 * (F.col("aligned") - F.col("matched")) / F.col("aligned"), 2)
    return own.select(F.col("header").alias("Node ID"), rank.alias("Rank"), F.col("norm_score").alias("Norm_Score"), F.col("score").alias("Raw_Score"), F.col("length").alias("Sequence_Length"), F.col("aligned").alias("Alignment_Length"), share("identical").alias("Percent_Identity"), share("similar").alias("Percent_Similarity"), gaps.alias("Percent_Gaps"))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """Plain lines or FASTA header lines; the accession of each where it has one."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    fasta = not lines.where(F.col("value").startswith(">")).isEmpty()
    own = lines.where(F.col("value").startswith(">")) if fasta else lines
    header = F.trim(F.regexp_replace("value", "^>", ""))
    return own.select(header.alias("header"), F.regexp_extract(header, r"\b([A-Z]{2}_\d{6,9}(?:\.\d+)?|[A-Z]{3}\d{5,7}(?:\.\d+)?)\b", 1).alias("accession"))


def export_labels(records: DataFrame, path: str, label: str, header: str = "header", seq: str = "seq") -> None:
    """FASTA files in a folder per label; multi-valued labels are exploded first."""
    own = records.withColumn(label, F.explode(label)) if dict(records.dtypes)[label].startswith("array") else records
    own.select(F.col(label).alias("label"), F.concat(F.lit(">"), F.col(header), F.lit("\n"), F.col(seq)).alias("value")).write.partitionBy("label").text(path)


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """``(column, type, rows, nulls, distinct)`` of a stored table; distinct is an estimate."""
    table = spark.read.parquet(path)
    kinds = dict(table.dtypes)
    plain = [c for c in table.columns if not kinds[c].startswith("map")]
    row = table.agg(F.count("*").alias("rows"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{k}") for k, c in enumerate(plain)), *(F.approx_count_distinct(F.col(f"`{c}`").cast("string") if "<" in kinds[c] else F.col(f"`{c}`")).alias(f"d{k}") for k, c in enumerate(plain)))
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col("rows"), F.col(f"n{k}").alias("nulls"), F.col(f"d{k}").alias("distinct")) for k, c in enumerate(plain)))
    return row.select(F.explode(each).alias("x")).select("x.*")


def save_table(rows: DataFrame, path: str) -> None:
    """Publish once; an existing table is an error."""
    rows.write.mode("errorifexists").parquet(path)


def load_layout(spark: SparkSession, path: str, nodes: int) -> DataFrame:
    """A saved layout ``(node, header, x, y, ..)``; other numbers of nodes, repeated nodes or places that are not finite are errors."""
    table = spark.read.parquet(path)
    n, kinds, bad = table.agg(F.count("*"), F.countDistinct("node"), F.count_if(~(F.abs("x") < float("inf")) | ~(F.abs("y") < float("inf")) | F.col("x").isNull() | F.col("y").isNull())).first()
    if n != nodes or kinds != nodes or bad:
        raise ValueError(f"a layout of {n} rows, {kinds} nodes and {bad} places that are not finite, for {nodes} nodes")
    return table
