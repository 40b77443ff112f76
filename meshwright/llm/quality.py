"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes some twenty shape features (no labels, language, source or id among them).  The
model is learnt by cyclic boosting: round after round, a shallow tree over the bins of one feature
fits the residuals and is added to that feature's lookup table; then the pairs with the largest
gain get two-dimensional tables in the same way.  A score is a sum of looked-up bins.

Fitting uses at most ``MAX_TRAIN`` labelled rows, the first by a hash of their id; features and
scores cover all rows and whole texts.  Null texts count as empty.  Rows without an id are scored and
never learnt from; of rows that repeat an
id the one of the least features is.  Labels repeated for an id count each; labels that are null or not 0/1 are left
out.  Without any labels every score is 0.5.  Very long texts are read whole, one at a time; extra
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwright.llm._common import arrow_map, batch_texts, chunks, materialize, text_bytes

#: Labelled rows that the model is fitted on at most.
MAX_TRAIN = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, RATE, LEAVES = 150, 0.1, 4
THRESHOLD = 0.7
NAMES = [
    "log_bytes", "upper", "digit", "space", "newline", "bar", "mark", "symbol", "stop", "comma", "high_byte", "log_words",
    "word_length", "distinct_words", "long_words", "upper_words", "symbol_end", "log_lines", "distinct_lines", "short_lines", "repeat_near",
]


def features(data: bytes) -> list[float]:
    """Shape of one text."""
    n = len(data)
    if not n:
        return [0.0] * len(NAMES)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = lambda signs: float(count[list(signs)].sum()) / n
    words, lines = data.split(), data.split(b"\n")
    w = max(1, len(words))
    joined = sum(map(len, words))
    return [
        np.log1p(n), float(count[65:91].sum()) / n, float(count[48:58].sum()) / n, share(b" "), share(b"\n"), share(b"|"), share(b"!?"), share(b"#$%&*@^~=<>{}[]\\"), share(b"."), share(b","), float(count[128:].sum()) / n,
        np.log1p(w), joined / w, len(set(words)) / w, sum(len(x) > 12 for x in words) / w, sum(map(bytes.isupper, words)) / w, sum(x[-1] in b"#$%&*!|" for x in words) / w,
        np.log1p(len(lines)), len(set(lines)) / len(lines), sum(len(x) < 20 for x in lines) / len(lines), sum(a == b for a, b in zip(words, words[1:], strict=False)) / w,
    ]


def with_features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, x)``: the features of every row."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat = np.array([features(t) for part in chunks(batch, "data") for t in part.column(1).to_pylist()], np.float32)
        offsets = pa.array(np.arange(batch.num_rows + 1, dtype="<i4") * len(NAMES))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat.reshape(-1)))], ["id", "x"])

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("data")), one, "id long, x array<float>")


@dataclass
class AdditiveModel:
    """Lookup tables per feature and per pair of features."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += t[np.searchsorted(e, x[:, j], "right")]
        if self.pairs:
            coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.pair_edges)]
            for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
                out += t[coarse[a], coarse[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Best-first regression tree over ordered bins with gradient sums ``g`` and weights ``h``; the value of every bin."""
    cg, ch = np.concatenate(([0], np.cumsum(g))), np.concatenate(([0], np.cumsum(h)))
    gain_of = lambda s, e: (cg[e] - cg[s]) ** 2 / (ch[e] - ch[s] + 1.0)
    parts = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, 0, 0)
        for k, (s, e) in enumerate(parts):
            if e - s > 1:
                m = np.arange(s + 1, e)
                gain = gain_of(s, m) + gain_of(m, e) - gain_of(s, e)
                if gain.max() > best[0]:
                    best = (float(gain.max()), k, int(m[gain.argmax()]))
        if not best[2]:
            break
        s, e = parts.pop(best[1])
        parts += [(s, best[2]), (best[2], e)]
    out = np.zeros(len(g))
    for s, e in parts:
        out[s:e] = (cg[e] - cg[s]) / (ch[e] - ch[s] + 1.0)
    return out


def _pair_step(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """A tree of two crossing cuts over a grid: the best row cut, and within each side its best column cut."""
    best, value = 0.0, np.zeros_like(g)
    for cut in range(1, len(g)):
        out, gain = np.zeros_like(g), 0.0
        for rows in (slice(0, cut), slice(cut, len(g))):
            t = _shallow_tree(g[rows].sum(0), h[rows].sum(0), 2)
            out[rows] = t
            gain += float((t * g[rows].sum(0)).sum())
        if gain > best:
            best, value = gain, out
    return value, best


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of the logistic loss."""
    rate = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(base=float(np.log(rate / (1 - rate))))
    quantiles = lambda n: [np.unique(np.quantile(x[:, j], np.arange(1, n) / n)) for j in range(x.shape[1])]
    model.edges, model.pair_edges = quantiles(BINS), quantiles(PAIR_BINS)
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    margin = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            p = 1 / (1 + np.exp(-margin))
            n = len(model.tables[j])
            step = RATE * _shallow_tree(np.bincount(b, y - p, n), np.bincount(b, p * (1 - p), n), LEAVES)
            model.tables[j] += step
            margin += step[b]
    coarse = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.pair_edges)]
    size = [len(e) + 1 for e in model.pair_edges]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[a] * size[b] + coarse[b], v, size[a] * size[b]).reshape(size[a], size[b])

    p = 1 / (1 + np.exp(-margin))
    gains = [(_pair_step(grid(a, b, y - p), grid(a, b, p * (1 - p)))[1], a, b) for a in range(x.shape[1]) for b in range(a)]
    model.pairs = [(a, b) for gain, a, b in sorted(gains, reverse=True)[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((size[a], size[b])) for a, b in model.pairs]
    for _ in range(ROUNDS // 5):
        for k, (a, b) in enumerate(model.pairs):
            p = 1 / (1 + np.exp(-margin))
            step, _ = _pair_step(grid(a, b, y - p), grid(a, b, p * (1 - p)))
            model.pair_tables[k] += RATE * step
            margin += RATE * step[coarse[a], coarse[b]]
    return model


def held_out(id_col: str) -> Column:
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % 4) == 2


def training_rows(labels: DataFrame, id_col: str = "doc_id", label: str = "quality", max_rows: int = MAX_TRAIN) -> DataFrame:
    """``(id, y)`` of the labelled rows to learn from: not held out, the first ``max_rows`` by a hash of their id."""
    known = labels.where(F.col(id_col).isNotNull() & ~held_out(id_col) & F.col(label).isin(0, 1)).select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y"))
    return known.withColumn("r", F.xxhash64("id")).orderBy("r", "id", "y").limit(max_rows).select("id", "y")


def train(featured: DataFrame, sample: DataFrame) -> AdditiveModel | None:
    """Fit on the rows of ``featured (id, x)`` in ``sample (id, y)``; None without any."""
    known = featured.join(F.broadcast(sample.select("id").distinct()), "id", "left_semi").groupBy("id").agg(F.min("x").alias("x"))
    rows = known.join(F.broadcast(sample), "id").select("y", "x").toPandas()  # max_rows at most
    if not len(rows):
        return None
    x, y = np.stack(rows["x"].to_numpy()).astype(np.float64), rows["y"].to_numpy(np.float64)
    order = np.lexsort((*x.T, y))  # the model does not depend on the order in which rows arrive
    return fit(x[order], y[order])


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, score, predicted)`` of every row."""
    featured = materialize(with_features(docs, id_col, text_col))
    model = train(featured, training_rows(labels, id_col))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1).astype(np.float64)
        score = model.score(x) if model else np.full(len(x), 0.5)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["id", "score", "predicted"])

    scored = arrow_map(featured, one, "id long, score double, predicted int").withColumnRenamed("id", id_col)
    return scored.select(id_col, F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject; all of them where there are no labels to learn from.

    The model is that of ``quality_scores`` on the same rows.  Texts are scored as they stream by, so
    that no text is shuffled: features of the labelled sample are computed first, then every row is
    scored and filtered in place.
    """
    sample = training_rows(labels, id_col)
    ids = sample.select("id").distinct()
    named = docs.join(F.broadcast(ids), docs[id_col].cast("long") == ids["id"], "left_semi")
    model = train(with_features(named, id_col, text_col), sample)
    if model is None:
        return docs

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([features(t) for part in chunks(batch_texts(batch, text_col), "data") for t in part.column(0).to_pylist()], np.float32).astype(np.float64)
        return batch.filter(pa.array(model.score(x) >= THRESHOLD))

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return arrow_map(docs, one, schema)
