"""Toxicity by cumulative-link ordinal regression over sparse text features.

Words (letters and digits, A-Z lower-cased) and their stems are the features, one if present.  The grades are ordered:
0 for rows labelled clean, and 1..GRADES-1 for rows labelled toxic, by how many different words
they use that the labels show to be toxic.  One weight per word is shared by all
thresholds: P(grade > k) = sigmoid(w.x - t_k).  The output is the expected grade.

Fitting uses at most ``MAX_TRAIN`` labelled rows and ``MAX_BYTES`` bytes (the first by a hash of their id), of
which the distinct words of the whole texts go to the driver, and a vocabulary of at most ``VOCABULARY``
words; scoring reads every row's whole text, however long.  Null texts count as empty; a text without
known words gets the model's base severity.  Rows without an id are scored, not learnt from; of rows that
repeat an id the one of the least words is learnt from.  Without toxic and clean labels every severity is
0.  Extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshwright.llm._common import arrow_map, text_bytes

MAX_TRAIN, MAX_BYTES, VOCABULARY, LEAST_ROWS = 8_000, 64 << 20, 2_000, 5
#: Lengths of stems in bytes.
STEMS = (4, 6)
GRADES = 4
STEPS, RATE, RIDGE = 400, 0.15, 1e-5
#: Deviations from chance at which a word enters the vocabulary: labels are noisy, and rare words would fit their noise.
#: Not in proportion to the best word's, which languages with few toxic rows would not reach.
SIGNIFICANT = 6.0
#: Log odds from which a word counts as toxic when grades are dealt.
TOXIC_ODDS = 2.0
#: Expected severity from which a text counts as toxic.
TOXIC_FROM = 0.1

_SIGNS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.lower().translate(_SIGNS).split()


def features_of(words: list[bytes]) -> set[bytes]:
    """The words of a text and their stems (first bytes, marked with a caret)."""
    unique = set(words)
    return unique.union(*({b"^" + w[:n] for w in unique if len(w) > n} for n in STEMS))


@dataclass
class OrdinalModel:
    weights: dict[bytes, float]
    thresholds: list[float]

    def severity(self, words: set[bytes]) -> tuple[float, int]:
        """Expected grade, and the grade of highest probability."""
        z = sum(map(self.weights.__getitem__, sorted(words & self.weights.keys())))
        above = [1 / (1 + math.exp(-max(-30.0, min(30.0, z - t)))) for t in self.thresholds]
        share = [1 - above[0], *(a - b for a, b in zip(above, above[1:], strict=False)), above[-1]]
        return sum(above), max(range(len(share)), key=lambda k: (share[k], -k))


def grade_rows(rows: list[list[bytes]], has: list[set[bytes]], toxic: np.ndarray) -> np.ndarray:
    """Ordered grades from binary labels: toxic rows by their number of words that the labels mark as toxic."""
    n = [max(1, int((toxic == v).sum())) for v in (0, 1)]
    seen = [Counter(), Counter()]
    for own, t in zip(has, toxic, strict=True):
        seen[int(t)].update(own)
    marked = {w for w, c in seen[1].items() if c >= LEAST_ROWS and math.log((c + 0.5) / n[1]) - math.log((seen[0][w] + 0.5) / n[0]) >= TOXIC_ODDS}
    heavy = lambda w: w in marked or any(b"^" + w[:n] in marked for n in STEMS if len(w) > n)
    rate = np.array([sum(map(heavy, set(words))) for words in rows], float)
    at = np.flatnonzero(toxic == 1)
    cuts = np.quantile(rate[at], np.arange(1, GRADES - 1) / (GRADES - 1)) if len(at) else []
    grades = np.zeros(len(rows), np.int64)
    grades[at] = 1 + np.searchsorted(cuts, rate[at], "left")
    return grades


def fit(rows: list[list[bytes]], toxic: np.ndarray) -> OrdinalModel:
    """Proportional-odds regression by full-batch Adam; deterministic in the order of rows."""
    has = [features_of(words) for words in rows]
    grades = grade_rows(rows, has, toxic)
    df, positive = Counter(), Counter()
    for own, t in zip(has, toxic, strict=True):
        df.update(own)
        if t:
            positive.update(own)
    share = toxic.mean()
    informative = lambda w: abs(positive[w] - share * df[w]) / math.sqrt(df[w] * share * (1 - share) + 1)
    worth = {w: informative(w) for w, c in df.items() if c >= LEAST_ROWS}
    chosen = sorted((w for w, x in worth.items() if x >= SIGNIFICANT), key=lambda w: (-worth[w], w))[:VOCABULARY]
    place = {w: k for k, w in enumerate(chosen)}
    found = [sorted(place[w] for w in own & place.keys()) for own in has]
    row_of = np.repeat(np.arange(len(rows)), [len(f) for f in found])
    col = np.array([c for f in found for c in f], np.int64)
    n, k = len(rows), GRADES - 1
    over = (grades[:, None] > np.arange(k)).astype(float)  # cumulative targets
    w, t = np.zeros(len(chosen)), np.linspace(1.0, 2.0, k)
    m, v = np.zeros(len(chosen) + k), np.zeros(len(chosen) + k)
    for step in range(1, STEPS + 1):
        z = np.bincount(row_of, w[col], n)
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - t, -30, 30)))
        d = (p - over) / n
        g = np.concatenate((np.bincount(col, d.sum(1)[row_of], len(chosen)) + RIDGE * w, -d.sum(0)))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, t = w - move[: len(chosen)], np.sort(t - move[len(chosen) :])  # thresholds stay in order
    return OrdinalModel({c: float(x) for c, x in zip(chosen, w, strict=True) if x}, t.tolist())


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", max_rows: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> OrdinalModel | None:
    """Fit on a bounded sample of the labelled rows; None unless both labels occur."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y"))
    sample = known.withColumn("r", F.xxhash64("id")).orderBy("r", "id", "y").limit(max_rows).select("id", "y")
    source = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("data")).join(F.broadcast(sample), "id")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [b" ".join(sorted(set(words_of(t)))) for t in batch.column(1).to_pylist()]  # each once: features only tell whether a word is there
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary()), batch.column(2)], ["id", "words", "y"])

    read = arrow_map(source.select("id", "data", "y"), one, "id long, words binary, y int")
    read = read.groupBy("id", "y").agg(F.min("words").alias("words"))  # rows that repeat an id: max_rows in all
    held = F.sum(F.octet_length("words")).over(Window.orderBy(F.xxhash64("id"), "id", "y").rowsBetween(Window.unboundedPreceding, 0))
    rows = sorted((r["id"], bytes(r["words"]), r["y"]) for r in read.where(F.octet_length("words") <= max_bytes).withColumn("held", held).where(F.col("held") <= max_bytes).collect())
    toxic = np.array([y for *_, y in rows], np.int64)
    if not len(rows) or toxic.min() == toxic.max():
        return None
    return fit([w.split() for _, w, _ in rows], toxic)


def severities(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, severity, grade, toxic)`` of every row: expected grade, likeliest grade, and 1 from TOXIC_FROM on."""
    model = train(docs, labels, id_col, text_col)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [model.severity(features_of(words_of(t))) if model else (0.0, 0) for t in batch.column(1).to_pylist()]
        severity = np.array([s for s, _ in out])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(severity), pa.array(np.array([g for _, g in out], np.int32)), pa.array((severity >= TOXIC_FROM).astype(np.int32))], ["id", "severity", "grade", "toxic"])

    scored = arrow_map(docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("data")), one, "id long, severity double, grade int, toxic int")
    return scored.withColumnRenamed("id", id_col)
