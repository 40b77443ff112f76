"""Networks as packed lists: results by brute force on awkward graphs, and no tables of wedges, flows or edges on the way."""

import random

import numpy as np
import pytest

from meshwright.operators import graph, packed

EDGES = "i long, j long, score double"


def network(seed: int, n: int, share: float) -> list[tuple[int, int, float]]:
    """Ids that are negative and large, a hub, and repeated edges."""
    rng = random.Random(seed)
    ids = [rng.randrange(-(2**40), 2**40) for _ in range(n)]
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if rng.random() < share or a == ids[0]]
    return [(min(p), max(p), round(rng.uniform(0.1, 1), 6)) for p in pairs + pairs[::7]]


def brute_jaccard(pairs) -> dict:
    near: dict[int, set] = {}
    for a, b, _ in pairs:
        near.setdefault(a, {a}).add(b)
        near.setdefault(b, {b}).add(a)
    return {(a, b): len(near[a] & near[b]) / len(near[a] | near[b]) for a, b, _ in pairs}


@pytest.mark.parametrize("group", [150, 10**9])
def test_jaccard_by_blocks_without_a_join(spark, monkeypatch, group):
    monkeypatch.setattr(packed, "GROUP", group)
    monkeypatch.setattr(packed, "AT_ONCE", 50)
    pairs = network(3, 60, 0.1)
    got = graph.jaccard(spark.createDataFrame(pairs, EDGES))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    found = [((r["i"], r["j"]), r["jaccard"]) for r in got.collect()]
    assert dict(found) == brute_jaccard(pairs) and len(found) == len(dict(found))
    assert graph.jaccard(spark.createDataFrame([], EDGES)).count() == 0


def test_groups_of_lists_are_not_dealt_out_as_copies(spark, monkeypatch):
    """Pairs of groups are read from where the lists are stored: no shuffle of a copy for each group; pieces of rising lists keep large ids and values."""
    monkeypatch.setattr(packed, "GROUP", 150)
    pairs = network(7, 60, 0.1)
    got = graph.jaccard(spark.createDataFrame(pairs, EDGES))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "CartesianProduct" in plan
    found = [((r["i"], r["j"]), r["jaccard"]) for r in got.collect()]
    assert dict(found) == brute_jaccard(pairs) and len(found) == len(dict(found))
    i, j, v = (np.array(c) for c in zip(*[(5, -(2**62), 0.25), (5, 2**62, 0.5), (-(2**61), 3, 1 / 3), (5, 3, 0.125)], strict=True))
    back = [packed.open_piece(data) for _, data in packed.pack_pieces([(i, j, v)], 4, True)]
    assert sorted(zip(*(np.concatenate(c).tolist() for c in zip(*back, strict=True)), strict=True)) == sorted([*zip(i.tolist(), j.tolist(), v.tolist(), strict=True), *zip(j.tolist(), i.tolist(), v.tolist(), strict=True)])


def test_jaccard_clusters_of_forests(spark, monkeypatch):
    """A clique and a ring of cliques: what goes on to the components is fewer edges than nodes, not all that reach the threshold."""
    seen = []
    connected = graph.connected_components

    def watched(edges, *ends):
        seen.append(edges.count())
        return connected(edges, *ends)

    monkeypatch.setattr(graph, "connected_components", watched)
    pairs = [(a, b, 1.0) for a in range(40) for b in range(a + 1, 40)] + [(100 + 5 * c + a, 100 + 5 * c + b, 1.0) for c in range(4) for a in range(5) for b in range(a + 1, 5)] + [(100 + 5 * c, 100 + 5 * ((c + 1) % 4) + 1, 1.0) for c in range(4)]
    pairs = [(min(p), max(p), w) for *p, w in pairs]
    nodes = spark.createDataFrame([(n,) for n in [*range(41), *range(100, 120)]], "node long")
    score, label = brute_jaccard(pairs), {n: n for n in [*range(41), *range(100, 120)]}
    for _ in label:
        for (a, b), x in score.items():
            if x >= 0.5:
                label[a] = label[b] = min(label[a], label[b])
    sizes = {r: list(label.values()).count(r) for r in set(label.values())}
    order = sorted((r for r in sizes if sizes[r] >= 3), key=lambda r: (-sizes[r], r))
    got = dict(map(tuple, graph.jaccard_clusters(nodes, spark.createDataFrame(pairs, EDGES), 0.5, 3).collect()))
    assert got == {n: order.index(r) + 1 if r in order else -1 for n, r in label.items()} and max(got.values()) == 5
    assert seen[0] < len(label)


def brute_flow(nodes, pairs, rounds: int) -> dict:
    m = np.zeros((len(nodes), len(nodes)))
    for a, b, w in pairs:
        m[nodes.index(a), nodes.index(b)] += w
        m[nodes.index(b), nodes.index(a)] += w
    for k, n in enumerate(nodes):
        m[k, k] = max((w for a, b, w in pairs if n in (a, b)), default=1.0)
    m /= m.sum(0)
    for _ in range(rounds):
        g = (m @ m) ** 2
        g /= g.sum(0)
        g[(g < 1e-3) & (g < g.max(0) - 1e-15)] = 0
        m = g / g.sum(0)
    return {(nodes[r], nodes[c]): m[r, c] for r, c in zip(*np.nonzero(m), strict=True)}


def test_markov_flow_by_groups_of_rows_and_columns(spark, monkeypatch):
    """No table of products: the flow of a network with a hub, repeated edges and a single node is that of a dense matrix."""
    monkeypatch.setattr(graph, "FLOW_ROWS", 100)
    monkeypatch.setattr(graph, "FLOW_COLUMNS", 150)
    pairs = network(5, 40, 0.1)
    nodes = sorted({n for a, b, _ in pairs for n in (a, b)}) + [7]
    frame = spark.createDataFrame([(n,) for n in nodes], "node long")
    got = graph.markov_flow(frame, spark.createDataFrame(pairs, EDGES), rounds=3)
    assert "Join" not in got._jdf.queryExecution().toString()
    found, want = {(r["r"], r["c"]): r["x"] for r in got.collect()}, brute_flow(nodes, pairs, 3)
    assert found.keys() == want.keys() and np.allclose([found[k] for k in want], list(want.values()))


def test_leiden_reduces_large_components(spark, monkeypatch):
    """A ring of cliques of more edges than a task takes, with some noise, beside a small component: the cliques are found."""
    monkeypatch.setattr(graph, "LEIDEN_EDGES", 200)
    monkeypatch.setattr(graph, "MOVES", 4)
    monkeypatch.setattr(graph, "PARTS", 3)
    pairs = [(8 * c + a, 8 * c + b, 1.0) for c in range(8) for a in range(8) for b in range(a + 1, 8)] + [tuple(sorted((8 * c, 8 * ((c + 1) % 8) + 1))) + (0.25,) for c in range(8)] + [(100, 101, 1.0), (101, 102, 1.0), (100, 102, 1.0)]
    nodes = spark.createDataFrame([(n,) for n in [*range(65), 100, 101, 102]], "node long")
    got = dict(map(tuple, graph.leiden_clusters(nodes, spark.createDataFrame(pairs, EDGES), 1.0, 3).collect()))
    assert got == {n: n // 8 + 1 if n < 64 else -1 if n == 64 else 9 for n in [*range(65), 100, 101, 102]}
