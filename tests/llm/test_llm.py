"""Training-data operators against brute force, on the smallest documents and hard cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from meshwright.llm import decontaminate, fingerprints, packing, pii, quality, secrets, simhash, substring_dedup, token_counts, toxicity

SF = "/root/testdata/sf0.001"
HARD = ["", None, " \n\t ", "a", "x" * 99, "x" * 100, "yx" * 60, "a" * 3000, "ba" + "a" * 300, "é" * 400, "1 2 " * 4000, "a@b.com_x@y.com a@b@c.com é x.@y.z..w@q.r", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.255", "4111 1111 1111 1111  4111-1111-1111-1111", "+1 (555) 123-4567 +1((((2 ++12 345 67 89", "PassWord='abc123' token:=x akia AKIA" + "A1" * 10 + " " + "0f" * 13]


@pytest.fixture(scope="module")
def rows(spark):
    got = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    return got + [(10_000 + k, t) for k, t in enumerate(HARD)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, id string").repartition(4).cache()


def test_fingerprints(docs, rows):
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_versions(docs).collect()}
    text = {i: t or "" for i, t in rows}
    order = sorted(text, reverse=True)
    for k, i in enumerate(order):
        third, after = len(text[i]) // 3, text[order[(k + 1) % len(order)]]
        edited = text[i][: len(text[i]) - third] + after[:third]
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["n_chars"] == len(text[i])
        if edited == text[i]:
            assert got[i]["near_edited"] == 1.0 and got[i]["fingerprint"] == got[i]["edited_fingerprint"]
    long = [r for r in got.values() if r["n_chars"] > 500 and r["doc_id"] < 10_000]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.95


def test_peeling_recovers_the_difference(spark):
    rng = random.Random(3)
    pairs = []
    for n in (0, 1, 5, 12, 40, 300):
        a = [rng.getrandbits(63) for _ in range(n)]
        pairs.append((a, a[n // 3 :] + [rng.getrandbits(63) for _ in range(n // 2)]))
    df = spark.createDataFrame(pairs, "a array<long>, b array<long>")
    from pyspark.sql import functions as F

    d = fingerprints.difference(F.col("a"), F.col("b"), fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b")))
    for r in df.select("a", "b", d.alias("d")).collect():
        assert set(r["d"]["left"]) == set(r["a"]) - set(r["b"]) and set(r["d"]["right"]) == set(r["b"]) - set(r["a"])


def test_fingerprints_share_what_longer_texts_share(spark):
    rng = random.Random(4)
    latin = lambda: " ".join("".join(rng.choice("ijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(70))
    greek = lambda: " ".join("".join(chr(rng.randrange(0x3B1, 0x3C9)) for _ in range(7)) for _ in range(90))
    han = lambda: "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(700))
    texts = [f() for f in (latin, greek, han) for _ in range(8)]
    got = fingerprints.fingerprint_versions(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["near_edited"], r["near_next"]) for r in got if r["near_edited"] <= max(0.25, r["near_next"])] == []


def test_substring_dedup(docs, rows, monkeypatch):
    seen, want = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        covered = bytearray(len(b))
        for p in range(len(b) - 99):
            if (w := b[p : p + 100]) in seen:
                covered[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, y in zip(b, covered, strict=True) if not y)
        want[i] = (len(b), sum(covered), sum(bool(x) for x in bytes(covered).split(b"\0")), hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substring_dedup.cut_repeats(docs).collect()}
    assert got == want


def test_simhash(docs, rows):
    prints = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if j < i and (prints[i] ^ prints[j]).bit_count() <= 3 and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", find(i)) for i in prints}


def test_hot_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)
    base = 0x0123456789ABCDEF
    index = spark.createDataFrame([(1, k, base ^ (1 << (k % 60)) ^ (1 << ((k // 2) % 60))) for k in range(60)], "key long, node long, w0 long")
    from meshwright.operators.components import connected_components

    got = connected_components(simhash.bucket_links(index, 1, 3)).select("component").distinct().count()
    monkeypatch.setattr(simhash, "BLOCK", 1000)
    assert got == connected_components(simhash.bucket_links(index, 1, 3)).select("component").distinct().count()


@pytest.mark.parametrize("limit", [simhash.GROUP_BYTES, 3_000])
def test_near_duplicates_are_as_alike_as_promised(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "GROUP_BYTES", limit)
    rng, texts = random.Random(5), []
    for _ in range(12):
        words = [f"w{rng.randrange(9_000)}" for _ in range(120)]
        for n in (0, 1, 2, 3, 4, 5, 6, 8, 10):
            copy = list(words)
            for k in rng.sample(range(120), n):
                copy[k] = f"x{rng.randrange(9_000)}"
            texts.append(" ".join(copy))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    near = {(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    root = list(range(len(texts)))
    for i, j in sorted(near) * 9:
        root[i] = root[j] = min(root[i], root[j])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicate_groups(df).collect()} == dict(enumerate(root))


def spans_of(kinds, text):
    found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m))
    return hashlib.sha256(",".join(f"{kinds[k][0]}:{s}:{e}" for s, k, e in found).encode()).hexdigest()


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def test_pii(docs, rows):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    ]
    got = {r["doc_id"]: r["base_sha256"] for r in pii.find_pii(docs).collect()}
    assert got == {i: spans_of(kinds, t or "") for i, t in rows}


def test_redact(spark):
    df = spark.createDataFrame([("mail é a@b.com or 4111 1111 1111 1111.",), (None,), ("GB82 WEST 1234 5698 7654 32 iban",)], "text string")
    assert [r["text"] for r in pii.redact(df).collect()] == ["mail é [EMAIL] or [CARD].", None, "[IBAN] iban"]


def test_ibans_before_words_and_numbers(spark):
    lines = ["GB82 WEST 1234 5698 7654 32 Please", "DE89370400440532013000 2024", "DE89 3704 0044 0532 0130 00 BIC X", "AB12 GB82 WEST 1234 5698 7654 32", "NO9386011117947 SEK", "DE89370400440532013000X", "GB82 WEST 1234 5698 7654 33 Please"]
    got = {r["doc_id"]: r["spans"] for r in pii.find_pii(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    spans = {k: [p for p in v.split(",") if p.startswith("iban")] for k, v in got.items()}
    assert spans == {0: ["iban:0:27"], 1: ["iban:0:22"], 2: ["iban:0:27"], 3: ["iban:5:32"], 4: ["iban:0:15"], 5: [], 6: []}


def test_secrets(docs, rows):
    word = "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    kinds = [("assign", rf"""(?:{word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)]
    got = {r["doc_id"]: r["base_sha256"] for r in secrets.find_secrets(docs).collect()}
    assert got == {i: spans_of(kinds, t or "") for i, t in rows}
    body = "A" * 30
    assert secrets.scan(f"ghp_{body}{secrets.crc_base62(body.encode())}".encode()) and not secrets.scan(f"ghp_{body}000000".encode())


def test_token_counts():
    own = token_counts.coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(1)
    for text in ["", "a", " \n  x", "it's  we'll   \n\n ok" * 40, "word " * 500]:
        tree = token_counts.TokenTree(text, own)
        for _ in range(30):
            a = rng.randint(0, len(tree.text))
            tree.edit(a, a + rng.choice([0, 1, 5, 300]), rng.choice(["", " ", "'", "  x\n", "s " * 100, "é12 "]))
            assert tree.tokens == len(own.encoding.encode_ordinary(tree.text))


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x in rows}
    got = packing.pack_documents(docs, path).collect()
    assert sum(r["length"] for r in got) == sum(map(len, ids.values()))
    sequences = {}
    for r in got:
        cut = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 2048 * r["piece"] and zlib.crc32(np.array(cut, "<u4").tobytes()) == r["ids_crc32"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(sequences) <= -(-sum(map(len, ids.values())) // 2048) * 1.05 + 1


def test_decontamination():
    index = decontaminate.Index([(1, b"When Alice has 3 apples and Bob has 12 apples. How many apples do Alice and Bob have after 5 days?"), (2, b""), (3, b"too short"), (4, b"one two red fish blue fish")])
    got = index.matches([b"When Carol has 7,000 apples and Dave has 2 apples. How many apples do Carol and Dave have after nine days?", b"When Carol has 7 apples and Dave has 2 apples. How many apples do Eve and Dave have after 9 days?", b"", b"xx one two red fish blue fish yy"])
    assert [(t, item) for t, item, *_ in got] == [(0, 1), (3, 4)]


def test_altered_copies_and_passages_are_found():
    question = "When %s has %d apples and Bob has %d apples. How many apples do %s and Bob have after 5 days?"
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}word" for k in range(59)]
    changed = [f"other{w}" if k % 12 == 11 else w for k, w in enumerate(words)]
    index = decontaminate.Index([(1, (question % ("Alice", 3, 12, "Alice")).encode()), (2, " ".join(words).encode())])
    texts = [question % ("Alice", 4, 4, "Alice"), question % ("Alice", 3, 12, "Eve"), question % ("Carol", 7, 2, "Eve"), " ".join(words[10:35]), " ".join(changed), " ".join(words[10:25])]
    assert [(t, item) for t, item, *_ in index.matches([t.encode() for t in texts])] == [(0, 1), (1, 1), (3, 2), (4, 2)]


def test_items_of_one_template_keep_their_values():
    text = "When %s has %d apples and %s has %d apples, how many apples do %s and %s have in all baskets?"
    items = [(1, text % ("Alice", 5, "Bob", 5, "Alice", "Bob")), (2, text % ("Alice", 5, "Bob", 7, "Alice", "Bob")), (3, text % ("Alice", 4, "Bob", 9, "Bob", "Alice"))]
    index = decontaminate.Index([(k, t.encode()) for k, t in items])
    got = index.matches([t.encode() for _, t in items])
    assert {(t, item) for t, item, *_, same in got if same} == {(0, 1), (1, 2), (2, 3)}
    got = index.matches([(text % ("Carol", 8, "Dave", 6, "Carol", "Dave")).encode()])
    assert [item for _, item, *_ in got] == [2]


def test_classifiers(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.quality_scores(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.85
    assert quality.quality_scores(d, labels.limit(0)).where("score = 0.5").count() == d.count()
    severe = {r["doc_id"]: r["toxic"] for r in toxicity.severities(d, labels).collect()}
    clean = [r["doc_id"] for r in labels.where("toxic = 0").collect()]
    assert np.mean([severe[i] for i in clean]) < 0.05
    assert toxicity.severities(d, labels.limit(0)).where("severity = 0").count() == d.count()


def test_toxic_texts_are_found_in_every_language(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.severities(d, labels).withColumnRenamed("toxic", "found").join(labels, "doc_id").join(d.select("doc_id", "lang"), "doc_id").where("toxic in (0, 1)").collect()
    for lang in {r["lang"] for r in got}:
        assert np.mean([r["found"] for r in got if r["lang"] == lang and r["toxic"] == 1]) > 0.85
    assert np.mean([r["found"] for r in got if r["toxic"] == 0]) < 0.03


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert fingerprints.fingerprint_versions(none).count() == substring_dedup.cut_repeats(none).count() == simhash.simhash_components(none).count() == 0
    assert pii.find_pii(none).count() == secrets.find_secrets(none).count() == packing.pack_documents(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_filters_keep_rows_as_they_are(spark):
    d, sf = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "/root/testdata/sf0.01"
    more = spark.createDataFrame([(None, None), (5_000_001, None), (5_000_002, ""), (5_000_003, "a")], "doc_id long, text string")
    docs = d.unionByName(more, allowMissingColumns=True).withColumn("data", d.lang).withColumn("_data", d.n_chars)
    labels, benchmark = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    leaks = {r["doc_id"] for r in decontaminate.contaminated(docs, benchmark).collect()}
    kept = decontaminate.drop_contaminated(docs, benchmark)
    assert kept.columns == docs.columns and leaks
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if r["doc_id"] not in leaks)
    good = quality.keep_good(docs, labels)
    assert good.columns == docs.columns
    chosen = {r["doc_id"] for r in quality.quality_scores(docs, labels).where("predicted = 1").collect()}
    assert len(chosen ^ {r["doc_id"] for r in good.collect()}) <= 0.002 * docs.count()  # features here are doubles, there floats


def test_near_duplicates_start_one_python_worker_a_task(spark, monkeypatch):
    """Links leave the worker that compares texts as forests: no second Python operator before the next shuffle."""
    seen = []
    connected = simhash.connected_components

    def watched(edges, *args, **options):
        plan = edges._jdf.queryExecution().executedPlan().toString()
        found = connected(edges, *args, **options)
        seen.append((plan, options.get("tied", False), edges))
        return found

    monkeypatch.setattr(simhash, "connected_components", watched)
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(k, f"{text} {' '.join(f'x{k}y{m}' for m in range(k % 3))}") for k in range(12)] + [(20, "another text of a few words")]
    got = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), ngram=5, similarity=0.8)
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 20]
    for plan, tied, edges in seen:
        first = next(line for line in plan.splitlines() if "MapInArrow" in line or "Exchange" in line)
        assert tied if "MapInArrow" in first else not tied
    edges = next(e for _, tied, e in seen if tied).collect()
    nodes = {x for e in edges for x in e}
    assert len(seen) == 2 and len(edges) == len(nodes) - 1
