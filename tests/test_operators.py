"""Small exact cases: hand-worked graphs, adversarial values, text formats, kernels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwright.functions import predicate
from meshwright.operators import alignment, dynamic, edges, graph, metadata, sequences, trees
from meshwright.operators.components import connected_components
from meshwright.sources import formats
from meshwright.streaming import windows

EDGES = "i long, j long, score double"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_every_pair_is_aligned_and_every_query_searched(spark, tmp_path):
    from meshwright.plans import catalog

    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(45, 64))
    df = spark.createDataFrame([(k, v.tolist(), k % 10) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["i"], r["j"]): r for r in catalog.queries()["dp_alignment"](spark, str(tmp_path)).collect()}
    assert set(got) == {(i, j) for j in range(45) for i in range(j)}
    for (i, j), r in got.items():
        s = dynamic.score_matrix(vectors[i].reshape(8, 8), vectors[j].reshape(8, 8))
        g, l = dynamic.align(s, 0.0), dynamic.align(s, -2.0, True)
        assert math.isclose(r["g_score"], g[0], abs_tol=1e-9) and math.isclose(r["l_score"], l[0], abs_tol=1e-9)
        assert (r["g_len"], r["l_len"], r["matched"]) == (g[1], l[1], len(g[2]))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = []
    for q in (0, 20, 40):
        best = sorted((-round(float(unit[q] @ unit[k]), 6), k) for k in range(45) if k != q)
        want += [(q, rank, k) for rank, (score, k) in enumerate(best[:20], 1) if -score >= 0.05]
    assert [x[:3] for x in rows(catalog.queries()["search_topk_queries"](spark, str(tmp_path)))] == want


def test_components_and_empty(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 101), (None, 5)], "a long, b long")
    got = dict(rows(connected_components(chain)))
    assert {got[k] for k in range(41)} == {0} and got[101] == 100
    assert connected_components(chain.limit(0)).count() == 0


def test_reduce_and_topk_with_nan(spark):
    e = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.7), (3, 3, 9.0), (1, 3, float("nan"))], EDGES)
    assert rows(edges.reduce_max(e.where("not isnan(score)"))) == [(1, 2, 0.7)]
    best = edges.strongest_directed(e.where("i <> j").withColumn("pos", F.monotonically_increasing_id()), 1)
    assert (1, 2, 0.5) in {r[:3] for r in rows(best.where("not isnan(score)"))}


def test_percent_cutoff_keeps_ties(spark):
    e = spark.createDataFrame([(0, 1, 3.0), (0, 2, 2.0), (1, 2, 2.0), (0, 3, 1.0)], EDGES)
    assert edges.percent_cutoff(e, 4, 34.0) == 2.0
    assert edges.percent_cutoff(e.limit(0), 4, 34.0) == 0.0


def test_two_threshold_rules(spark):
    e = spark.createDataFrame([(0, 1, 0.7)], EDGES).withColumn("score", F.col("score").cast("float"))
    assert edges.at_least(e, 0.7, rule="layout").count() == 1
    assert edges.at_least(e, 0.7).count() == 0


def test_jaccard_markov_and_forest(spark):
    clique = [(a, b, 1.0) for a in range(4) for b in range(a + 1, 4)]
    e = spark.createDataFrame(clique + [(4, 5, 0.9), (3, 4, 0.01)], EDGES)
    j = {(a, b): x for a, b, x in rows(graph.jaccard(e))}
    assert j[0, 1] == 1.0 and j[3, 4] == 2 / 6
    nodes = spark.range(7).withColumnRenamed("id", "node")
    got = dict(rows(graph.markov_clusters(nodes, e, rounds=5)))
    assert got[0] == got[3] == 1 and got[4] == got[5] == 2 and got[6] == 3
    forest = graph.spanning_forest(e)
    assert forest.count() == 5 and math.isclose(sum(r["score"] for r in forest.collect()), 3.91)


def test_selection_language(spark):
    n = spark.createDataFrame([("a red", 1.0, "x", "K"), ("b", None, "", None), ("c RED", float("nan"), "xy", "-")], "header string, v double, t string, aa string")
    ctx = predicate.Context(numbers={"V": "v"}, texts={"T": "t"}, residue=lambda p: F.col("aa"))
    keep = lambda text: [r["header"] for r in n.where(predicate.mask(text, ctx)).orderBy("header").collect()]
    assert keep('"red"') == ["a red", "c RED"]
    assert keep("{V!=2}") == ["a red"] and keep("!{V=2}") == ["a red", "b", "c RED"]
    assert keep("{T!=x}") == ["b"] and keep("{V=(-1)-1}") == ["a red"]
    assert keep("K1") == ["a red"] and keep("!K1") == ["c RED"] and keep("_1") == ["c RED"]
    assert keep('"red"&!K1|{V=1}') == ["a red", "c RED"]
    for bad in ('"red"&', "(K1", "{Nope=1}", "#cluster_1#", "{T>1}", "K1 K1", "{V=x}"):
        with pytest.raises(predicate.SelectionError):
            predicate.mask(bad, ctx)


def test_metadata_merge_keeps_old_values(spark):
    n = spark.createDataFrame([("h", 1.0), ("g", 2.0)], "header string, v double")
    up = spark.createDataFrame([("h", "5", 0), ("h", "", 1), ("g", "bad", 2)], "header string, v string, k int")
    assert rows(metadata.merge(n, up, "header", {"v": "number"}, "k")) == [("g", 2.0), ("h", 5.0)]


def test_unique_headers_skip_taken_names(spark):
    r = spark.createDataFrame([("n", "A", 0), ("n", "B", 1), ("n_1", "C", 2)], "header string, seq string, pos long")
    assert {(x["seq"], x["header"]) for x in sequences.unique_headers(r).collect()} == {("A", "n_2"), ("B", "n_3"), ("C", "n_1")}


def test_identity_window(spark):
    msa = alignment.long_form(spark.createDataFrame([(0, "AC-D"), (1, "-CED"), (2, "A---")], "row long, s string"), "row", "s")
    got = alignment.identities(msa, spark.createDataFrame([(0, 1), (1, 2)], "a long, b long"))
    assert {(r["a"], r["b"]): r["identity"] for r in got.collect()} == {(0, 1): 2 / 3, (1, 2): None}
    assert alignment.parse_positions("[1-2,2.1,END]", ["1", "2", "2.1", "3"]) == ["1", "2", "2.1", "3"]


def brute(s, gap):
    n, m = s.shape
    h = np.zeros((n + 1, m + 1))
    h[:, 0], h[0] = gap * np.arange(n + 1), gap * np.arange(m + 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            h[i, j] = max(h[i - 1, j - 1] + s[i - 1, j - 1], h[i - 1, j] + gap, h[i, j - 1] + gap)
    return h[n, m]


def test_dynamic_programming():
    s = np.random.default_rng(1).normal(0, 2, (7, 9))
    assert math.isclose(dynamic.align(s, -0.5)[0], brute(s, -0.5))
    score, length, cells = dynamic.align(s, -2.0, local=True)
    assert score >= 0 and length >= len(cells)
    assert dynamic.align(np.zeros((0, 3)), -1.0)[:2] == (-3.0, 3)
    path = dynamic.affine(s)
    assert [i for i, _ in path if i >= 0] == list(range(7)) and [j for _, j in path if j >= 0] == list(range(9))
    merged = dynamic.progressive([np.eye(4)[:3], np.eye(4), np.eye(4)[1:]], [(0, 1), (2, 3)])
    assert len({len(c) for c in merged}) == 1


def test_trees(spark):
    d = np.array([[0, 2, 6, 6], [2, 0, 6, 6], [6, 6, 0, 4], [6, 6, 4, 0]], float)
    assert trees.upgma(d) == [(0, 1, 1.0), (2, 3, 2.0), (4, 5, 3.0)]
    assert len(trees.neighbour_joining(d)) == 3
    assert trees.consensus_support(d, 20)[frozenset({0, 1})] == 1.0
    t = trees.parse_newick("((a:1,'b c':2)x:0.5,d:3);")
    assert trees.parse_newick(trees.write_newick(t)) == t
    assert trees.intervals(t)[1] == (1, 0, 1)
    with pytest.raises(ValueError):
        trees.parse_newick("((a,b);")
    df = spark.createDataFrame(t, trees.TREE)
    assert {r["node"]: r["distance"] for r in trees.tree_index(df).collect()}[3] == 2.5
    clades = spark.createDataFrame(trees.intervals(t), "node int, first int, last int")
    assert trees.smallest_clade(clades, spark.createDataFrame([(0,), (1,)], "leaf int")).first()[0] == 1


def test_formats(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one two\nAC\nDE\n>b\nKK\n")
    r = formats.read_fasta(spark, str(tmp_path / "a.fasta"))
    assert rows(r) == [("b", "KK", 1), ("one two", "ACDE", 0)]
    formats.write_fasta(r, str(tmp_path / "out"), order="pos")
    assert rows(formats.read_fasta(spark, str(tmp_path / "out"))) == rows(r)
    line = "a\tb\t90.0\t10\t1\t0\t1\t10\t1\t10\t1e-5\t50\n"
    (tmp_path / "h.tsv").write_text(line + line.replace("a\tb", "b\ta").replace("1e-5", "1e-9"))
    manifest = spark.createDataFrame([("a", 0), ("b", 1)], "header string, node long")
    got = formats.network_of_hits(formats.read_hits(spark, str(tmp_path / "h.tsv")), manifest).first()
    assert (got["i"], got["j"]) == (0, 1) and math.isclose(got["score"], 9.0)
    (tmp_path / "h7.txt").write_text("# BLASTP 2.1\n# Query: q1\n# Fields: subject id, evalue\nx\t1\n# Query: q2\n# Fields: subject id, evalue\ny\t2\n")
    assert [x["query"] for x in formats.read_commented_hits(spark, str(tmp_path / "h7.txt")).collect()] == ["q1", "q2"]
    (tmp_path / "m.csv").write_text(",Score,Name\n,number,text\nn1,1.5,\nn2,bad,x\n")
    assert rows(formats.read_metadata(spark, str(tmp_path / "m.csv")).drop("order")) == [("n1", 1.5, ""), ("n2", None, "x")]


def test_stream_matches_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    q = windows.tumbling(stream, "1 hour").writeStream.outputMode("complete").format("memory").queryName("hours").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("hours").count() == windows.tumbling(events, "1 hour").count()
    store = str(tmp_path / "store")
    assert windows.append_new(events.limit(10), store, ["event_id"]) == 10
    assert windows.append_new(events.limit(10), store, ["event_id"]) == 0
