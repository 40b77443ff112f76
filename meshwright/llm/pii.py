"""Personal data by regular expressions, checksum validators and context words, in DataFrame functions only.

Each kind's pattern marks its matches in the text with a control sign that the patterns cannot
match; splitting at the sign gives the stretches between and the matches, whose lengths give the
offsets.  Luhn confirms card numbers, mod-97 confirms IBANs, and words near a span raise its score;
an added span without a checksum counts only if such a word stands near it.

Null texts count as empty and give no spans.  Offsets are code points, end exclusive.  Repeated rows
are read each for itself; extra columns are left alone.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.llm._common import free_name, text_or_empty

# The kinds in their order (the first four are the base) and their patterns.  A run
# that cannot match from its start is not tried again from within, which keeps long texts linear.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE = 4
#: Characters of an IBAN by country: those of the registry, and of countries that use IBANs without an entry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_KNOWN = "|".join(" ".join(IBAN_LENGTHS.values()).split())
#: A known country's IBAN has that country's length whatever follows; others run on, up to one of a known country.
_IBAN = "|".join(rf"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}+" for n, c in IBAN_LENGTHS.items())
_IBAN += rf"|(?!{_KNOWN})[A-Z]{{2}}[0-9]{{2}}(?:(?:\x20(?!(?:{_KNOWN})[0-9]{{2}}))?[A-Z0-9]){{11,30}}+"
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_IBAN})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Words that raise a span's score within CONTEXT code points before or after it.
WORDS = {
    "email": "mail|contact|write to",
    "ip": "ip|address|host|server",
    "card": "card|visa|credit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|konto",
    "ssn": "ssn|social security|tax id",
}
#: What must be in a text before its pattern is tried.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
CONTEXT = 40
#: Score of a span: its pattern, a confirmed checksum, a context word; added spans need KEPT.
PATTERN_SCORE, CHECKSUM_SCORE, WORD_SCORE, KEPT = 0.5, 0.4, 0.2, 0.7
MARK, OTHER = "\u0001", "\u0002"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, (n - i).cast("int"), F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an IBAN's check digits are right."""
    plain = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i.cast("int"), F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}")
    if kind == "card":
        n = F.length(_digits(m))
        return F.when((n >= 12) & (n <= 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "iban":
        return mod97(m)
    return F.lit(True)


def _spans(text: Column, kind: str) -> Column:
    """Array of valid spans of one kind, in order."""
    pieces = F.split(F.regexp_replace(text, PATTERNS[kind], f"{MARK}$0{MARK}"), MARK)
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>").alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        span = F.struct(acc["at"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), piece.alias("value"))
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(pieces, start, step)["found"]
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    possible = F.size(pieces) > 1
    kept = F.when(possible, F.filter(found, lambda s: _valid(kind, s["value"]))).otherwise(none)
    return F.when(F.contains(text, F.lit(NEEDS[kind])), kept).otherwise(none) if kind in NEEDS else kept


def _scored(text: Column, spans: Column, kind: str) -> Column:
    """Spans of one kind with their scores; added kinds only where the score suffices."""
    checked = CHECKSUM_SCORE if kind in ("card", "iban") else 0.0
    pattern = rf"(?i)\b(?:{WORDS[kind]})"

    def score(s: Column) -> Column:
        low = F.greatest(s["start"] - CONTEXT, F.lit(0))
        near = F.concat(F.substring(text, low + 1, s["start"] - low), F.lit(" "), F.substring(text, s["end"] + 1, F.lit(CONTEXT)))
        points = F.lit(PATTERN_SCORE + checked) + F.when(near.rlike(pattern), WORD_SCORE).otherwise(0.0)
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.round(F.least(points, F.lit(1.0)), 2).alias("score"))

    scored = F.transform(spans, score)
    return scored if KINDS.index(kind) < BASE else F.filter(scored, lambda s: s["score"] >= KEPT)


def with_spans(docs: DataFrame, text_col: str = "text", out: str = "_pii") -> DataFrame:
    """``docs`` with ``out``: array of ``(start, kind, end, score)`` sorted by start, then kind."""
    own = free_name(docs, "_pii_text")
    of = {kind: free_name(docs, f"_pii_{kind}") for kind in KINDS}
    found = docs.withColumn(own, F.translate(text_or_empty(text_col), MARK, OTHER))
    for kind in KINDS:
        found = found.withColumn(of[kind], _spans(F.col(own), kind))
    scored = [_scored(F.col(own), F.col(of[kind]), kind) for kind in KINDS]
    return found.withColumn(out, F.array_sort(F.concat(*scored))).drop(own, *of.values())


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_email, n_ip, n_card, n_phone, n_iban, n_ssn, base_sha256, spans, scores)`` of every row."""
    found = with_spans(docs.select(id_col, text_col), text_col)
    base = F.filter(F.col("_pii"), lambda s: s["kind"] < BASE)

    def count(k: int) -> Column:
        return F.size(F.filter(F.col("_pii"), lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(len(KINDS))]
    scores = F.concat_ws(",", F.transform("_pii", lambda s: s["score"].cast("string")))
    return found.select(id_col, *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("_pii")).alias("spans"), scores.alias("scores"))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one. Null texts stay null."""
    own = free_name(docs, "_pii")
    found = with_spans(docs, text_col, own)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        between = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        parts = F.when(s["start"] >= acc["at"], F.concat(acc["parts"], F.array(between, F.element_at(names, s["kind"] + 1)))).otherwise(acc["parts"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("parts"))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text)))

    cleaned = F.when(F.size(own) > 0, F.aggregate(own, start, step, finish)).otherwise(text)
    return found.withColumn(text_col, cleaned).drop(own)
