"""Connected components over an edge table, by alternating large-star and small-star rounds.

Hot nodes never meet in one task: least neighbours are aggregated partially, and a node of more than
``HUB`` edges gets its least neighbour from a broadcast table instead of a join on the node.  That
table has at most ``HUBS`` rows, whatever the graph: the limit rises with the number of edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwright.session import materialize

#: Edges of a node that are joined in one task at least, and nodes whose edges are not.
HUB, HUBS = 64, 50_000
#: Edges of a task that are made a forest at once, and nodes of a task's forest at which it is let go.
LOCAL, NODES = 1 << 20, 1 << 22


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges, rising, and the least node that each is tied to by them."""
    ids, place = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, root = place[: len(a)], place[len(a) :], np.arange(len(ids))
    while len(x):
        x, y = root[x], root[y]
        apart = x != y
        x, y = np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart])
        np.minimum.at(root, x, y)
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return ids, ids[root]


def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges ``(a, b)`` as stars of what they tie together."""
    held, size, new = [], 0, 0

    def tied() -> tuple[np.ndarray, np.ndarray]:
        node, root = local_components(*(np.concatenate(c) for c in zip(*held, strict=True)))
        return node[node != root], root[node != root]

    def out(star: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(star[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[s : s + (1 << 16)]) for c in star], ["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            new += batch.num_rows
        if new >= max(LOCAL, size):
            star = tied()
            held, size, new = [star], len(star[0]), 0
            if size > NODES:
                yield from out(star)
                held, size = [], 0
    if held:
        yield from out(tied())


def _with_least(edges: DataFrame, n: int) -> DataFrame:
    """``edges (a, b)`` with ``m``: the least ``b`` of their ``a``; ``n`` is at least the number of edges."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    limit = max(HUB, -(-n // HUBS))
    hubs = low.where(F.col("n") > limit).select("a", F.col("m").alias("hub"))
    marked = edges.join(F.broadcast(hubs), "a", "left")  # n / limit rows at most
    # Edges of hubs are spread by a hash that need not find anything.
    key = F.when(F.col("hub").isNull(), F.col("a")).otherwise(F.xxhash64("a", "b").cast(edges.schema["a"].dataType))
    found = marked.withColumn("key", key).join(low.select(F.col("a").alias("key"), "m"), "key", "left")
    return found.select("a", "b", F.coalesce("hub", "m").alias("m"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, 2 * n).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Edges lead from greater to smaller nodes; all others of a node are tied to its least, and so is the node."""
    found = _with_least(edges, n)
    return found.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(edges.groupBy("a").agg(F.min("b").alias("b")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", tied: bool = False, max_rounds: int = 60) -> DataFrame:
    """Return ``(node, component)`` for every node of an edge; component is its smallest node.

    Self edges and rows with a null end are ignored; repeated edges count once; without edges the
    result is empty.  Each round is checkpointed to shared storage, so a lost executor costs at most
    that round.  ``tied``: tasks whose Python makes the edges have passed them through ``forests`` there;
    a second Python operator in such a stage would double the workers of every executor.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(f"`{a}` is not null and `{b}` is not null and a <> b")
    kinds = dict(e.dtypes)
    if not tied and set(kinds.values()) <= {"tinyint", "smallint", "int", "bigint"}:  # tasks keep a forest of their edges before any meet
        e = e.select(*(F.col(c).cast("long") for c in "ab")).mapInArrow(forests, "a long, b long").select(*(F.col(c).cast(k) for c, k in kinds.items()))
    e = materialize(e.distinct())
    state = (e.count(), None)
    for _ in range(max_rounds):
        if not state[0]:
            break
        e = materialize(_small_star(_large_star(e, state[0]).distinct(), state[0]).where("a <> b").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
