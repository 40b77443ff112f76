"""Clustering, trees, ranks, names, formats and imputation on small exact cases and against brute force."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshwright.operators import components, edges, graph, imputation, profiles, sequences, trees
from meshwright.operators.components import connected_components
from meshwright.sources import formats

EDGES = "i long, j long, score double"


def rows(df):
    return sorted(map(tuple, df.collect()))


def sets(labels):
    """Clusters as sets of nodes."""
    out = {}
    for node, label in labels:
        out.setdefault(label, set()).add(node)
    return sorted(map(sorted, out.values()))


def test_components_with_hubs(spark, monkeypatch):
    """A hub beyond the limit, in a table where the broadcast holds few of them."""
    monkeypatch.setattr(components, "HUB", 4)
    rng = random.Random(1)
    for n, m, hub in ((300, 250, 0), (40, 10, 30), (500, 60, 400)):
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] + [(n - 1, k) for k in range(hub)] + [(0, n // 2 + k) for k in range(hub // 4)]
        root = list(range(n))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in pairs:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        got = dict(rows(connected_components(spark.createDataFrame(pairs, "a long, b long"))))
        assert got == {i: find(i) for e in pairs for i in e if e[0] != e[1]}


# --- clusters ----------------------------------------------------------------------------------------------------


def quality_of(n, pairs, group, resolution=1.0):
    total = sum(w for *_, w in pairs)
    inner = sum(w for a, b, w in pairs if group[a] == group[b])
    strength = [sum(w * ((a == v) + (b == v)) for a, b, w in pairs) for v in range(n)]
    return inner / total - resolution * sum(sum(strength[v] for v in range(n) if group[v] == g) ** 2 for g in set(group)) / (2 * total) ** 2


def partitions(n):
    if n == 0:
        yield []
        return
    for rest in partitions(n - 1):
        for g in range(max(rest, default=-1) + 2):
            yield [*rest, g]


def test_leiden_against_all_partitions():
    rng = random.Random(4)
    worst = 0.0
    for _ in range(12):
        n = 7
        pairs = [(a, b, rng.choice([1.0, 2.0, 0.5])) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.45]
        if not pairs:
            continue
        a, b, w = (np.array(x) for x in zip(*pairs, strict=True))
        found = graph.leiden(n, a, b, w)
        best = max(quality_of(n, pairs, p) for p in partitions(n))
        worst = max(worst, best - quality_of(n, pairs, found.tolist()))
        shuffled = rng.sample(pairs, len(pairs))
        x, y, v = (np.array(z) for z in zip(*[(q, p, s) if rng.random() < 0.5 else (p, q, s) for p, q, s in shuffled], strict=True))
        assert (graph.leiden(n, x, y, v) == found).all()  # the order and direction of edges do not count
    assert worst < 0.05


def test_leiden_on_cliques_and_what_is_not_in_any(spark):
    """A ring of cliques, two single nodes, and scores that cannot be used."""
    pairs = [(5 * c + a, 5 * c + b, 1.0) for c in range(8) for a, b in itertools.combinations(range(5), 2)] + [(5 * c, 5 * ((c + 1) % 8) + 1, 0.5) for c in range(8)]
    nodes, e = spark.range(42).withColumnRenamed("id", "node"), spark.createDataFrame(pairs, EDGES)
    got = rows(graph.cluster(nodes, e, "leiden", None, 3))
    assert sets([x for x in got if x[1] > 0]) == [list(range(5 * c, 5 * c + 5)) for c in range(8)]
    assert [n for n, c in got if c == -1] == [40, 41]
    assert {c for _, c in rows(graph.cluster(nodes, e, "leiden", 1.0, 1))} == set(range(1, 11))
    labels = graph.cluster(nodes, e, "leiden", None, 3)
    assert math.isclose(graph.modularity(e, labels), quality_of(42, pairs, [c if c > 0 else 100 + n for n, c in got]), abs_tol=1e-12)
    with pytest.raises(ValueError):
        graph.cluster(nodes, e.withColumn("score", F.lit(float("nan"))), "leiden")
    for mode, value in (("leiden", float("inf")), ("mcl", 1.0), ("jaccard", 1.5), ("other", None)):
        with pytest.raises(ValueError):
            graph.cluster(nodes, e, mode, value)
    with pytest.raises(ValueError):
        graph.cluster(nodes, e.withColumn("score", F.lit(0.0)), "mcl")
    names = rows(graph.subclusters(spark.createDataFrame([(n, 1 + n // 20) for n in range(40)], "node long, cluster int"), e, 2, "leiden", 1.0, 3))
    assert sets(names) == [list(range(5 * c, 5 * c + 5)) for c in range(4, 8)] and names[0][1].startswith("subcluster_2_")


def test_later_markov_clusters_overwrite_and_remnants_are_noise(spark):
    """Rows {0,1,2,3}, {3,4,5,6} and {6,7}: 3 goes to the second, 6 to the third; of {4,5} too few are left with 3 as the least size."""
    flow = [(0, c, 0.5) for c in (0, 1, 2, 3)] + [(4, c, 0.5) for c in (3, 4, 5, 6)] + [(6, c, 0.5) for c in (6, 7)]
    nodes, f = spark.range(9).withColumnRenamed("id", "node"), spark.createDataFrame(flow, "r long, c long, x double")
    assert sets([x for x in rows(graph.markov_labels(nodes, f, 1)) if x[1] > 0]) == [[0, 1, 2], [3, 4, 5], [6, 7]]
    assert dict(rows(graph.markov_labels(nodes, f, 3)))[6] == dict(rows(graph.markov_labels(nodes, f, 3)))[5]
    assert [n for n, c in rows(graph.markov_labels(nodes, f, 4)) if c == -1] == [0, 1, 2, 7, 8]


def test_threshold_tree_merges_equal_heights(spark):
    e = spark.createDataFrame([(0, 1, 5.0), (1, 2, 5.0), (0, 2, 5.0), (2, 3, 4.0), (4, 5, 3.0), (5, 6, 1.0), (0, 3, float("nan"))], EDGES)
    got = rows(graph.threshold_tree(graph.spanning_forest(e)))
    assert got == [(0, 4.0, 0, 4, None, None), (0, 5.0, 0, 3, 4.0, 0), (4, 1.0, 4, 3, None, None), (4, 3.0, 4, 2, 1.0, 4)]
    assert graph.forest_root(e) == (5.0, 1.0 - 0.05 * 4.0)
    assert graph.forest_root(e.limit(0)) == (0.0, -1.0)


def test_spanning_forest_is_greatest(spark):
    rng = random.Random(9)
    pairs = [(a, b, rng.choice([0.1, 0.2, 0.3, 0.9])) for a, b in itertools.combinations(range(30), 2) if rng.random() < 0.2]
    root, want = list(range(30)), []

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b, s in sorted(pairs, key=lambda e: (-e[2], e[0], e[1])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.append((a, b, s))
    assert rows(graph.spanning_forest(spark.createDataFrame(pairs, EDGES))) == sorted(want)


# --- ranks, samples, imputation ------------------------------------------------------------------------------------


@pytest.mark.parametrize(("bins", "singly"), [(1024, 10_000), (4, 6), (2, 0)])
def test_ranked_values(spark, monkeypatch, bins, singly):
    monkeypatch.setattr(edges, "RANK_BINS", bins)
    monkeypatch.setattr(edges, "RANK_VALUES", singly)
    rng = random.Random(3)
    for values in ([rng.gauss(0, 1) for _ in range(300)], [1.0] * 50 + [2.0] * 3, [1e-300, 0.0, -1e300, 5.0, float("inf") / float("inf") if False else 7.0], [3.0]):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        ranks = sorted({0, len(values) - 1, len(values) // 2, len(values) // 3})
        assert edges.ranked_values(df, "x", ranks) == [sorted(values)[r] for r in ranks]
        fractions = [0.0, 0.1, 0.5, 0.77, 1.0]
        assert np.allclose(edges.quantile_values(df, "x", fractions), np.quantile(values, fractions), rtol=1e-12, atol=0 if values[0] != 1e-300 else 1e290)
    assert edges.quantile_values(df.limit(0), "x", [0.5]) == []


def test_percent_cutoff_with_nan(spark):
    e = spark.createDataFrame([(0, 1, float("nan")), (0, 2, 2.0), (1, 2, 2.0), (0, 3, 1.0)], EDGES)
    assert math.isnan(edges.percent_cutoff(e, 4, 1.0)) and edges.percent_cutoff(e, 4, 50.0) == 2.0 and edges.percent_cutoff(e, 4, 100.0) == 1.0
    assert edges.percent_cutoff(e.limit(0), 4, 10.0) == 0.0


def test_calibration_sample_draws_alike_from_every_band(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(k, k + 1, rng.random()) for k in range(4000)], EDGES)
    got = edges.calibration_sample(df, 0.8, size=205, bands=10).collect()
    below = sorted(r["score"] for r in df.collect() if r["score"] < 0.8)
    cuts = np.quantile(below, np.linspace(0, 1, 11))
    band = lambda x: min(max(int(np.searchsorted(cuts, x, "right")) - 1, 0), 9)
    members = np.bincount([band(x) for x in below], minlength=10)
    taken = np.bincount([band(r["score"]) for r in got], minlength=10)
    assert taken.tolist() == [21] * 5 + [20] * 5 and len({(r["i"], r["j"]) for r in got}) == 205
    assert all(math.isclose(r["weight"], members[band(r["score"])] / taken[band(r["score"])]) for r in got)
    assert {r["weight"] for r in edges.calibration_sample(df, 0.8).collect()} != {1.0} and edges.calibration_sample(df, 0.001, size=10**6).where("weight <> 1").count() == 0


def test_located_pairs(spark):
    e = spark.createDataFrame([(2, 1, 0.5, 10), (1, 2, 0.6, 4), (3, 3, 0.1, 1), (0, 3, 0.2, 7)], f"{EDGES}, pos long")
    got = rows(edges.locate_pairs(spark.createDataFrame([(1, 2), (3, 0), (3, 3), (0, 1)], "i long, j long"), e))
    assert got == [(0, 1, -1), (0, 3, 7), (1, 2, 4), (3, 3, -1)]


def test_monotone_fit_is_least_squares(spark):
    rng = np.random.default_rng(2)
    for _ in range(20):
        x, y, w = rng.integers(0, 6, 9).astype(float), rng.normal(size=9), rng.integers(1, 4, 9).astype(float)
        fit = imputation.fit_monotone(x, y, w)
        loss = lambda v, x=x, y=y, w=w: float((w * (np.array([v[k] for k in x.astype(int)]) - y) ** 2).sum())
        own = fit(np.arange(6.0))
        assert (np.diff(own) >= -1e-12).all()
        for _ in range(300):  # no rising function near it is better
            other = np.maximum.accumulate(own + rng.normal(scale=rng.choice([0.01, 0.3]), size=6))
            assert loss(own) <= loss(other) + 1e-9
    pairs = spark.createDataFrame([(0, 1, 0.1), (0, 2, 0.5), (1, 2, 0.9), (0, 3, 0.3)], "i long, j long, similarity double")
    known = spark.createDataFrame([(0, 1, 1.0), (1, 2, 3.0)], EDGES)
    got = {(r["i"], r["j"]): (round(r["distance"], 9), r["imputed"]) for r in imputation.imputed_distances(pairs, known).collect()}
    assert got == {(0, 1): (2.0, False), (1, 2): (0.0, False), (0, 2): (1.0, True), (0, 3): (1.5, True)}


def test_fit_with_a_sample_is_checked_on_what_it_left_out(spark):
    rng = random.Random(7)
    observed = [(k, 10_000 + k, x := rng.random(), 2 * x + rng.gauss(0, 0.01)) for k in range(400)]
    df = spark.createDataFrame(observed, "i long, j long, similarity double, score double")
    sample = spark.createDataFrame([(k, 10_000 + k, 5.0) for k in range(40)], "i long, j long, weight double")
    fit, check = imputation.fit_imputation(df, sample)
    assert check["pairs"] == 20 and check["rho"] > 0.98 and check["r2"] > 0.98 and abs(fit(np.array([0.5]))[0] - 1) < 0.05
    assert imputation.fit_imputation(df, sample.limit(5))[1] is None and imputation.fit_imputation(df)[1] is None


def test_fit_takes_every_observed_pair(spark):
    """Beyond 100,000 pairs too, in stretches that are pooled apart and then together."""
    rng = np.random.default_rng(4)
    n = 130_000
    x, y = np.round(rng.normal(size=n), 3), rng.normal(size=n)
    y += np.where(rng.random(n) < 0.5, x, 0)
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(n), "j": np.arange(n) + n, "similarity": x, "score": y}))
    got, want = imputation.fit_imputation(df)[0], imputation.fit_monotone(x, y)
    assert np.array_equal(got.x, want.x) and np.allclose(got.y, want.y, rtol=0, atol=1e-9)


def test_imputed_distances_are_of_a_fit_to_all_known_pairs(spark, tmp_path):
    from meshwright.plans import catalog

    v = np.random.default_rng(6).normal(size=(850, 64))
    spark.createDataFrame([(k, x.tolist(), k % 10) for k, x in enumerate(v)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    i, j = np.triu_indices(len(v), 1)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round((u @ u.T)[i, j], 6)
    known, score = (i + j) % 3 == 0, np.round(s * np.abs(s) + 0.1, 6)
    assert known.sum() > 110_000
    fit = imputation.fit_monotone(s[known], score[known])
    top = score[known].max()
    want = np.clip(top - np.where(known, score, fit(s)), 0, top - min(0, fit.y.min()) + 0.1)
    got = catalog.queries()["imputed_distances"](spark, str(tmp_path)).toPandas().sort_values(["i", "j"])
    assert np.array_equal(got[["i", "j"]], np.stack((i, j), axis=1)) and np.array_equal(got["imputed"], ~known)
    assert np.allclose(got["distance"], want, rtol=0, atol=1e-9)


# --- names, rows, formats ------------------------------------------------------------------------------------------


def names_by_hand(records):
    """Suffixes one by one: reserved and used names are skipped."""
    by_header = {}
    for h, s, p in sorted(records, key=lambda r: r[2]):
        by_header.setdefault(h, []).append((s, p))
    used, out = set(), []
    for h, own in by_header.items():
        k, joint = 1, "" if h.endswith("_") else "_"
        for s, p in own:
            name = h
            if len(own) > 1:
                while (name := f"{h}{joint}{k}") in by_header or name in used:
                    k += 1
                k += 1
            used.add(name)
            out.append((h, name, s, p))
    return sorted(out, key=lambda r: r[3])


def test_unique_headers_skip_taken_names(spark):
    rng = random.Random(6)
    for _ in range(4):
        pool = ["a", "a_", "a_1", "a_3", "a_1_2", "b", "b_", "b_2", "c_01", "c", "a_10"]
        records = [(rng.choice(pool), f"s{k}", k * 7919 % 25_000) for k in range(40)]
        got = sequences.unique_headers(spark.createDataFrame(records, "header string, seq string, pos long"))
        assert sorted(map(tuple, got.collect()), key=lambda r: r[3]) == names_by_hand(records)


def test_manifest_faults_are_told(spark):
    for records in ([("a", "M", 0), ("a", "K", 1)], [("a b", "M", 0), ("a  b", "K", 1)], [(" ", "M", 0)], [("a", "", 0)]):
        with pytest.raises(ValueError):
            sequences.header_manifest(spark.createDataFrame(records, "header string, seq string, pos long"))


def test_identity_against_brute_force(spark):
    rng = random.Random(8)
    seqs = ["".join(rng.choice("ACDX--") for _ in range(12)) for _ in range(70)] + ["-" * 12, "XXXXXXXXXXXX"]
    df = spark.createDataFrame(list(enumerate(seqs)), "row long, seq string")

    def identity(x, y):
        both = [k for k in range(12) if x[k] != "-" and y[k] != "-"]
        if not both:
            return None
        span = range(both[0], both[-1] + 1)
        n = sum(x[k] != "-" or y[k] != "-" for k in span)
        return round(sum(x[k] == y[k] and x[k] in "ACD" for k in span) / n, 9)

    got = {(r["a"], r["b"]): None if r["identity"] is None else round(r["identity"], 9) for r in profiles.identity_pairs(df).collect()}
    assert got == {(a, b): identity(seqs[a], seqs[b]) for a, b in itertools.combinations(range(len(seqs)), 2)}
    cross = {(r["a"], r["b"]): None if r["identity"] is None else round(r["identity"], 9) for r in profiles.cross_identity(df.where("row < 9"), df.where("row >= 40")).collect()}
    assert cross == {(a, b): identity(seqs[a], seqs[b]) for a in range(9) for b in range(40, len(seqs))}
    near = lambda x, y: (u := sum(p in "ACD" or q in "ACD" for p, q in zip(x, y, strict=True))) and sum(p == q and p in "ACD" for p, q in zip(x, y, strict=True)) >= 0.5 * u - 1e-12
    weights = {r["row"]: round(r["weight"], 9) for r in profiles.identity_weights(df, 0.5).collect()}
    assert weights == {a: round(1 / max(1, sum(bool(near(x, y)) for y in seqs)), 9) for a, x in enumerate(seqs)}
    labelled = df.withColumn("g", (F.col("row") % 3 - 1).cast("int"))
    for r in profiles.group_identity(labelled, "g").collect():
        own = [identity(seqs[a], seqs[b]) for a, b in itertools.combinations([k for k in range(len(seqs)) if k % 3 - 1 == r["group"]], 2)]
        own = [v for v in own if v is not None]
        assert r["pairs"] == len(own) and math.isclose(r["mean"], 100 * np.mean(own), rel_tol=1e-6) and math.isclose(r["least"], 100 * min(own), abs_tol=1e-6)
    assert profiles.group_identity(labelled, "g", exact_pairs=10, sample_pairs=100).where("not sampled").count() == 0
    table = profiles.identity_table(profiles.identity_pairs(df), [0, 1, 70]).collect()
    assert [r["1"] for r in table if r["row"] == 1] == ["100.00"] and [r["0"] for r in table if r["row"] == 70] == [""]


@pytest.mark.parametrize("text", ["[K>10%]", "[(K>10%)&((DE)>=0.2)]", "[!(K>10) | (_<50%) ^ (GAP>=1)]", "[((K>0.1))]"])
def test_frequency_logic_reads_what_it_should(text):
    assert callable(profiles.frequency_logic(text))


@pytest.mark.parametrize("text", ["[]", "[K>10% & D>5%]", "[(K>10%)&]", "[((K>10%)]", "[(KD>10%)]", "[(K=10%)]"])
def test_frequency_logic_refuses_the_rest(text):
    with pytest.raises(ValueError):
        profiles.frequency_logic(text)


def test_fasta_keeps_the_order_of_files(spark, tmp_path):
    (tmp_path / "b.fa").write_text(">x one\nMK\nL\n\n>y\nAA\n")
    (tmp_path / "a.fa").write_text("﻿>z\nGG\n>empty\n>w\nC C\r\n")
    got = [(r["header"], r["seq"]) for r in formats.read_fasta(spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == [("z", "GG"), ("empty", ""), ("w", "CC"), ("x one", "MKL"), ("y", "AA")]


@pytest.mark.parametrize("text", ["", ">a\nMK\n>b\nMKL\n", ">a\nMK\n>a\nML\n", ">a b\nMK\n>a  b\nML\n", ">a\n\n>b\nMK\n", "> \nMK\n"])
def test_alignments_are_strict(spark, tmp_path, text):
    (tmp_path / "m.fa").write_text(text)
    with pytest.raises(ValueError):
        formats.read_alignment(spark, str(tmp_path / "m.fa"))


def test_metadata_of_several_files(spark, tmp_path):
    (tmp_path / "one.csv").write_text(",Size,Kind\n,number,text\na,1,x\nb,,\n")
    (tmp_path / "two.csv").write_text(",Kind,Age\n,text,num\na,y,2.5\nc,NA,bad\n")
    got = formats.read_metadata(spark, str(tmp_path)).orderBy("order")
    assert [(r["header"], r["Size"], r["Kind"], r["Age"]) for r in got.collect()] == [("a", 1.0, "x", None), ("b", None, "", None), ("a", None, "y", 2.5), ("c", None, "NA", None)]
    (tmp_path / "three.csv").write_text(",Size\n,length\na,1\n")
    with pytest.raises(ValueError):
        formats.read_metadata(spark, str(tmp_path))


def test_networks_and_embeddings_are_checked(spark):
    assert formats.network_kind(["i", "j", "score"], "BLAST") == "blast"
    for args in ((["i", "j"], "blast"), (["i", "j", "score"], "model"), (["i", "j", "score"], " "), (["i", "j", "score"], "blast", "bits")):
        with pytest.raises(ValueError):
            formats.network_kind(*args)
    good = ("a", "MK", [[1.0, 2.0], [3.0, 4.0]])
    bad = [("a/b", "M", [[1.0, 2.0]]), ("r", "M", [[1.0, 2.0]]), ("r", "M", [[1.0, 2.0]]), ("e", "", []), ("s", "m", [[1.0, 2.0]]), ("n", "MK", [[1.0, 2.0]]), ("w", "M", [[1.0]]), ("f", "M", [[1.0, float("nan")]])]
    found = dict(rows(formats.check_embeddings(spark.createDataFrame([good, *bad], "header string, seq string, embedding array<array<double>>"))))
    assert found == {"a/b": "unsafe header", "r": "repeated header", "e": "no sequence", "s": "sequence not clean", "n": "other number of residues", "w": "other width", "f": "values not finite"}


def test_custom_hits_are_strict(spark, tmp_path):
    for name, text in (("a", "q\ts\t1\nq\ts\n"), ("b", "q\ts\t-1\n"), ("c", "q\ts\tx\n")):
        (tmp_path / name).write_text(text)
        with pytest.raises(Exception):  # noqa: B017, PT011
            formats.read_custom_hits(spark, str(tmp_path / name), 1, 2, 3).collect()


def test_search_report(spark):
    hits = [("q", 9.0, 1.0, 10, 10, 10, 10, 10, True), ("b", 5.0, 0.5, 12, 10, 4, 6, 8, False), ("a", 5.0, 0.5, 12, 10, 4, 6, 8, False), ("c", 1.0, 0.1, 9, 8, 1, 2, 8, False)]
    df = spark.createDataFrame(hits, "header string, score double, norm_score double, length int, aligned int, identical int, similar int, matched int, is_query boolean")
    got = [(r["Node ID"], r["Rank"], r["Percent_Identity"], r["Percent_Gaps"]) for r in formats.hit_report(df, 3, 0.2).orderBy("Rank").collect()]
    assert got == [("a", 1, 40.0, 20.0), ("b", 2, 40.0, 20.0)]
    assert formats.hit_report(df, -1, 0.0, stored=False).count() == 4


# --- trees -------------------------------------------------------------------------------------------------------


def test_midpoint_halves_the_longest_way():
    for text in ("((a:1,b:5):1,c:2,(d:1,e:1):3);", "(a:1,b:9);", "((a:2,b:2):4,c:1);"):
        got = trees.midpoint(trees.parse_newick(text))
        up = {n: (p, x or 0.0) for n, p, x, _ in got}

        def depth(n, up=up):
            return 0.0 if up[n][0] < 0 else up[n][1] + depth(up[n][0])

        far = sorted((depth(n) for n, _, _, label in got if label), reverse=True)
        assert math.isclose(far[0], far[1]) and {r[3] for r in got if r[3]} == {c for c in text if c.isalpha()}
        assert got[0][1] == -1 and all(p < n for n, p, *_ in got)


def test_other_tree_formats():
    want = [(-1, None, ""), (0, 1.0, "a"), (0, 2.0, ""), (2, 0.5, "b"), (2, 0.5, "c")]
    xml = '<phyloxml xmlns="http://www.phyloxml.org"><phylogeny rooted="true"><clade><clade branch_length="1"><name>a</name></clade><clade><branch_length>2</branch_length><clade><name>b</name><branch_length>0.5</branch_length></clade><clade branch_length="0.5"><name>c</name></clade></clade></clade></phylogeny></phyloxml>'
    nested = '{"tree": {"node_attrs": {"div": 0}, "children": [{"name": "a", "node_attrs": {"div": 1}}, {"node_attrs": {"div": 2}, "children": [{"name": "b", "node_attrs": {"div": 2.5}}, {"name": "c", "length": 0.5}]}]}}'
    jplace = '{"tree": "(a:1{0},(b:0.5{1},c:0.5{2}):2{3}){4};", "placements": []}'
    for got in (trees.parse_phyloxml(xml), trees.parse_nested_json(nested), trees.parse_nested_json(jplace)):
        assert [r[1:] for r in got] == want
    again = trees.parse_newick(trees.write_nexus(trees.parse_nested_json(jplace), "it's", {"WRITTEN": "now"}))
    assert [r[1:] for r in again] == want
