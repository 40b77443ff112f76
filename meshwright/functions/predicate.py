"""The Boolean selection language, compiled to a Column.

    "text"  substring or wildcard of the header     {Key op value}  metadata
    #name#  cluster_N, noise or a group             P106, (RHK)71   residue at a position, _ for a gap
    @name@  a stored set of headers                 $sele$          the current selection

Operators bind as ``!``, ``&``, ``^``, ``|``, with parentheses.  Residue atoms are unknown (null) on
rows without an alignment; Kleene logic is SQL's, and a row is selected only where the whole is true.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class SelectionError(ValueError):
    """A malformed expression or an unknown name."""


_ATOM = re.compile(r'\s*(?:(?P<text>"[^"]*")|(?P<file>@[^@]+@)|(?P<label>#[^#]+#)|(?P<meta>\{[^}]*\})|(?P<sele>\$sele\$)|\((?P<set>[A-Za-z]{2,})\)(?P<setpos>\(-\d+(?:\.\d+)?\)|\d+(?:\.\d+)?)|(?P<aa>[A-Za-z_])(?P<pos>\(-\d+(?:\.\d+)?\)|\d+(?:\.\d+)?)|(?P<op>[!&^|()]))')
_META = re.compile(r"\{\s*(.+?)\s*(>=|<=|!=|==|=|>|<)\s*(.*?)\s*\}$")
_RANGE = re.compile(r"^(\(-[\d.]+\)|[\d.]+)\s*-\s*(\(-[\d.]+\)|[\d.]+)$")


def glob_pattern(pattern: str) -> str:
    """A whole-string regular expression for ``* ? [seq]``."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        close = pattern.find("]", k + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            inner = pattern[k + 1 : close].replace("\\", "\\\\")
            out += f"[{'^' + inner[1:] if inner[0] == '!' else inner}]"
            k = close
        else:
            out += re.escape(c)
        k += 1
    return f"(?s)^{out}$"


def _number(text: str) -> float:
    return float(text.strip("()"))


@dataclass
class Context:
    """What an expression's names mean for a table of nodes."""

    header: str = "header"
    cluster: str | None = None
    groups: str | None = None
    selected: str | None = None
    numbers: dict[str, str] = field(default_factory=dict)
    texts: dict[str, str] = field(default_factory=dict)
    files: dict[str, Column] = field(default_factory=dict)
    providers: dict[str, Callable[[str], Column]] = field(default_factory=dict)
    residue: Callable[[str], Column] | None = None

    def text(self, value: str) -> Column:
        low = value.lower()
        h = F.lower(self.header)
        found = h.contains(low)
        return found | h.rlike(glob_pattern(low)) if any(c in low for c in "*?[") else found

    def label(self, name: str) -> Column:
        if ":" in name:
            space, value = name.split(":", 1)
            if space not in self.providers:
                raise SelectionError(f"unknown namespace {space!r}")
            return self.providers[space](value)
        m = re.fullmatch(r"cluster_(\d+)", name.lower())
        if m or name.lower() == "noise":
            if not self.cluster:
                raise SelectionError("there are no clusters")
            return F.col(self.cluster) == (int(m[1]) if m else -1)
        if not self.groups:
            raise SelectionError(f"unknown group {name!r}")
        return F.exists(self.groups, lambda g: F.lower(g) == name.lower())

    def meta(self, body: str) -> Column:
        m = _META.match(body)
        if not m:
            raise SelectionError(f"malformed metadata predicate {body!r}")
        key, op, value = m[1], m[2], m[3].strip("\"'")
        numbers = {k.lower(): v for k, v in self.numbers.items()}
        texts = {k.lower(): v for k, v in self.texts.items()}
        if key.lower() in numbers:
            c = F.col(numbers[key.lower()]).cast("double")
            there = c.isNotNull() & ~F.isnan(c)
            if r := _RANGE.match(value):
                if op not in ("=", "=="):
                    raise SelectionError("a range takes =")
                return F.coalesce(there & c.between(_number(r[1]), _number(r[2])), F.lit(False))
            try:
                v = F.lit(_number(value))
            except ValueError:
                raise SelectionError(f"{value!r} is not a number") from None
            test = {">": c > v, "<": c < v, ">=": c >= v, "<=": c <= v, "=": c == v, "==": c == v, "!=": c != v}[op]
            return F.coalesce(there & test, F.lit(False))
        if key.lower() in texts:
            if op not in ("=", "==", "!="):
                raise SelectionError(f"{op} does not apply to text")
            c, low = F.lower(F.coalesce(F.col(texts[key.lower()]), F.lit(""))), value.lower()
            test = c.rlike(glob_pattern(low)) if any(x in low for x in "*?") else c.contains(low)
            return ~test if op == "!=" else test
        raise SelectionError(f"unknown key {key!r}")

    def amino(self, letters: str, position: str) -> Column:
        if self.residue is None:
            raise SelectionError("there is no alignment")
        c = self.residue(position.strip("()"))
        wanted = ["-" if x == "_" else x.upper() for x in dict.fromkeys(letters)]
        return c.isin(wanted)  # null where the row is not aligned


def parse(text: str, context: Context) -> Column:
    """The expression as a nullable Boolean Column."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _ATOM.match(text, at)
        if not m or m.end() == at:
            raise SelectionError(f"unexpected {text[at : at + 10]!r}")
        tokens.append(m)
        at = m.end()
    place = 0

    def peek() -> str | None:
        return tokens[place]["op"] if place < len(tokens) else ""

    def unary() -> Column:
        nonlocal place
        if place >= len(tokens):
            raise SelectionError("the expression ends early")
        t = tokens[place]
        place += 1
        if t["op"] == "!":
            return ~unary()
        if t["op"] == "(":
            inner = binary(0)
            if peek() != ")":
                raise SelectionError("a parenthesis is not closed")
            place += 1
            return inner
        if t["op"]:
            raise SelectionError(f"unexpected {t['op']!r}")
        if t["text"]:
            return context.text(t["text"][1:-1])
        if t["file"]:
            if t["file"][1:-1] not in context.files:
                raise SelectionError(f"unknown list {t['file']!r}")
            return context.files[t["file"][1:-1]]
        if t["label"]:
            return context.label(t["label"][1:-1])
        if t["meta"]:
            return context.meta(t["meta"])
        if t["sele"]:
            if not context.selected:
                raise SelectionError("there is no selection")
            return F.col(context.selected)
        return context.amino(t["set"], t["setpos"]) if t["set"] else context.amino(t["aa"], t["pos"])

    levels = ["|", "^", "&"]
    join = {"|": lambda a, b: a | b, "^": lambda a, b: a != b, "&": lambda a, b: a & b}

    def binary(level: int) -> Column:
        nonlocal place
        if level == len(levels):
            return unary()
        left = binary(level + 1)
        while peek() == levels[level]:
            place += 1
            left = join[levels[level]](left, binary(level + 1))
        return left

    out = binary(0)
    if place < len(tokens):
        raise SelectionError(f"unexpected {tokens[place][0]!r}")
    return out


def mask(text: str, context: Context) -> Column:
    """TRUE only where the expression is true."""
    return F.coalesce(parse(text, context), F.lit(False))


def select(nodes: DataFrame, found: Column, mode: str = "change", selected: str = "selected", visible: str = "visible") -> DataFrame:
    """Update the selection among visible nodes: change, add, subtract, filter, toggle or invert."""
    now, hit = F.coalesce(F.col(selected), F.lit(False)), found & F.col(visible)
    new = {"change": hit, "add": now | hit, "subtract": now & ~hit, "filter": now & hit, "toggle": now != hit, "invert": F.col(visible) & ~now}
    if mode not in new:
        raise SelectionError(f"unknown mode {mode!r}")
    return nodes.withColumn(selected, new[mode])
