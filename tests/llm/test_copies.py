"""SimHash, suffix trees, embeddings: against brute force, and odd rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from plumbline.llm import components, forest, queries, simhash, suffixes
from plumbline.llm.words import Words, runs_of_equal, sliding_minimum

SF = "/root/testdata/sf0.001"


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_words_and_minima():
    w = Words("  Ab c \n dE\x0bf", lower=True)
    assert w.normal == "ab c de f".encode() and w.n == 3 and w.slice(1, 3) == b"de f" and w.slice(1, 1) == b""
    values = np.array([5, 3, 4, 1, 6, 2])
    assert sliding_minimum(values, 4).tolist() == [1, 1, 1]
    assert [x.tolist() for x in runs_of_equal(np.array([1, 1, 2, 1]))] == [[0, 2, 3], [2, 1, 1]]


def test_components_of_chains_and_hubs(spark, rows):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = dict(rows(components.connected_components(spark.createDataFrame(links, "a bigint, b bigint"))))
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 160)}
    assert rows(components.connected_components(spark.createDataFrame([], "a bigint, b bigint"))) == []


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    counts = [sum(xxhash.xxh64_intdigest(s, 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_fingerprint_is_spark_hash_majority(spark):
    from pyspark.sql import functions as F

    shingle = spark.range(1).select(F.xxhash64(F.lit("the quick fox")).alias("h")).first().h
    assert simhash.fingerprint("The QUICK fox") == shingle % 2**64
    for text in (None, "", "one", "a b", "a b c d " * 300, "É É x y z"):
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_anchors_are_the_perfect_hamming_code(spark):
    rng = random.Random(1)
    words = sorted({rng.getrandbits(64) - 2**63 for _ in range(200)})
    prints = spark.createDataFrame([(w,) for w in words], "fp bigint")
    home = {}
    for r in simhash.homes(prints).collect():
        home.setdefault(r.home, []).append(r.anchor)
    seen = {}
    for r in simhash.visits(prints).collect():
        seen.setdefault(r.guest, []).append(r.anchor)
    for w in words:
        assert len(home[w]) == 2 and set(home[w]) <= set(seen[w])
        for anchor in home[w]:
            part, word = anchor % 2, anchor // 2
            assert ((w >> 31 * part & (2**31 - 1)) ^ word).bit_count() <= 1
        assert len(seen[w]) == len(set(seen[w])) and all(
            ((w >> 31 * (a % 2) & (2**31 - 1)) ^ a // 2).bit_count() <= 2 for a in seen[w]
        )


@pytest.mark.parametrize("crowd, block", [(32, 2048), (1, 3)])
def test_no_link_is_lost(spark, rows, monkeypatch, crowd, block):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(2)
    prints = []
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(12):
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                base ^= 1 << bit
            prints.append(base)
    prints = sorted({p - 2**64 if p >> 63 else p for p in prints})
    pairs = [(a, b) for a in prints for b in prints if a < b and ((a ^ b) % 2**64).bit_count() <= 3]
    links = simhash.fingerprint_links(spark.createDataFrame([(p,) for p in prints], "fp bigint"))
    got = dict(rows(components.connected_components(links)))
    want = brute_components(prints, pairs)
    assert {p: got.get(p, p) for p in prints} == want


def test_simhash_query_against_all_pairs(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {d: simhash.fingerprint(t) for d, t in docs.items()}
    linked = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    want = brute_components(prints, linked)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op6_simhash"](spark, SF).collect()}
    assert got == {d: (f"{prints[d]:016x}", want[d]) for d in docs} and linked


def test_simhash_odd_rows(odd_docs, no_docs):
    got = sorted(((r.id, r.component_id, r.fp == 0) for r in simhash.simhash_components(odd_docs).collect()), key=str)
    assert got == sorted(
        [(1, 1, False), (1, 1, False), (2, 2, True), (3, 2, True), (6, 2, True), (None, None, False), (4, 4, False), (4, 4, False),
         (5, 4, False), (7, 7, False)], key=str)
    assert simhash.simhash_components(no_docs).count() == 0
    stay = simhash.one_of_each(odd_docs)
    assert stay.columns == odd_docs.columns
    assert sorted((str(r.doc_id), len(r.text or "")) for r in stay.collect())[:3] == [("1", 9), ("2", 0), ("4", 19)]
    assert simhash.one_of_each(no_docs).count() == 0


def slow_cut(docs, length):
    """docs: list of (id or None, text), each judged by itself."""
    order = [(float("inf") if d is None else d) for d, _ in docs]
    words = [(t or "").encode().split() for _, t in docs]
    first = {}
    for o, ws in zip(order, words):
        for i in range(len(ws) - length + 1):
            w = tuple(ws[i : i + length])
            first[w] = min(first.get(w, o), o)
    out = []
    for o, ws in zip(order, words):
        gone = set()
        for i in range(len(ws) - length + 1):
            if first[tuple(ws[i : i + length])] < o:
                gone.update(range(i, i + length))
        out.append(b" ".join(w for i, w in enumerate(ws) if i not in gone).decode())
    return out


@pytest.mark.parametrize("crowd", [2048, 1])
def test_cut_against_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    monkeypatch.setattr(suffixes, "GROUP_WORDS", 500)
    rng = random.Random(3)
    passage = [f"p{rng.randint(0, 40)}" for _ in range(60)]
    texts = []
    for i in range(60):
        own = [f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 120))]
        at = rng.randint(0, len(own))
        texts.append(" ".join(own[:at] + passage[: rng.randint(8, 60)] * rng.randint(0, 2) + own[at:]))
    texts += texts[:10] + ["z " * 200, "z " * 90, "", None]
    docs = list(enumerate(texts)) + [(None, texts[3]), (5, texts[5]), (5, texts[7])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for length in (10, 50):
        got = sorted((str(r.doc_id), r.kept_text, r.n_words - r.n_removed) for r in suffixes.cut_repeats(df, length=length).collect())
        want = sorted((str(d), k, len(k.split(" ")) if k else 0) for (d, _), k in zip(docs, slow_cut(docs, length)))
        assert got == want


def test_tree_has_the_maximal_repeats_as_deep_nodes():
    runs = [b"a b c d e", b"x b c d y", b"b c d", b"a b"]
    tree = suffixes.Tree(runs, 3)
    at, depth = tree.maximal_repeats(3)
    assert sorted(zip(tree.run[at].tolist(), (at - tree.starts[tree.run[at]]).tolist())) == [(0, 1), (1, 1), (2, 0)]
    assert depth.tolist() == [3, 3, 0]
    # "c d" follows "b" everywhere, so only "b c d" is maximal; "a b" follows two marks.
    at, _ = suffixes.Tree(runs, 2).maximal_repeats(2)
    assert sorted(zip(tree.run[at].tolist(), (at - tree.starts[tree.run[at]]).tolist())) == [(0, 0), (0, 1), (1, 1), (2, 0), (3, 0)]
    assert suffixes.Tree([], 50).maximal_repeats(50)[0].tolist() == []
    assert suffixes.Tree([b"", b"a"], 1).maximal_repeats(1)[0].tolist() == []


def test_depth_with_a_smaller_id_is_of_the_lowest_shared_node():
    assert suffixes.depth_with_earlier([2, 1, 1, 3, 2], [9, 8, 7, 6, 0]).tolist() == [9, 0, 0, 7, 6]
    assert suffixes.depth_with_earlier([], []).tolist() == [] and suffixes.depth_with_earlier([4], [0]).tolist() == [0]


@pytest.mark.parametrize("length", [1, 3, 8])
def test_groups_against_all_windows(length):
    dice = random.Random(length)
    for _ in range(150):
        split = [[f"w{dice.randrange(3)}" for _ in range(dice.randrange(40))] for _ in range(5)]
        split[1] = list(split[0])
        docs = [dice.randrange(3) for _ in split]
        earliest = {}
        for words, doc in zip(split, docs):
            for i in range(len(words) - length + 1):
                key = tuple(words[i : i + length])
                earliest[key] = min(doc, earliest.get(key, doc))
        want = {
            (r, j) for r, words in enumerate(split) for i in range(len(words) - length + 1)
            if earliest[tuple(words[i : i + length])] < docs[r] for j in range(i, i + length)
        }
        table = pa.table({"doc": pa.array(docs, pa.int64()), "t": pa.array(range(5), pa.int64()), "first": pa.array([2] * 5, pa.int32()),
                          "words": pa.array([" ".join(w).encode() for w in split], pa.binary())})
        spans = suffixes._repeats_in_group(length)(table).to_pylist()
        assert {(x["t"], j - 2) for x in spans for j in range(x["s"], x["e"])} == want


def test_long_runs_of_one_line_are_dealt_by_window(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "CROWD_WORDS", 500)
    def no_tree(length):
        def fail(table):
            raise AssertionError("words of a crowded name in one group")
        return fail
    monkeypatch.setattr(suffixes, "_repeats_in_group", no_tree)
    docs = [(i, "one line again and again " * (60 + i)) for i in range(3)]
    got = {r.doc_id: r.n_removed for r in suffixes.cut_repeats(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert got == {0: 0, 1: 305, 2: 310}


def test_cut_odd_rows(odd_docs, no_docs):
    got = {(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()[:6] if r.n_words < 100 else "") for r in suffixes.cut_repeats(odd_docs).collect()}
    assert {(d, n, k) for d, n, k, _ in got} == {(1, 5, 0), (2, 0, 0), (3, 0, 0), (None, 3, 0), (4, 20000, 0), (4, 4, 0), (5, 20001, 20000), (6, 0, 0), (7, 6, 0)}
    assert suffixes.cut_repeats(odd_docs).count() == 10 and suffixes.cut_repeats(no_docs).count() == 0


def slow_vectors(data, cosine):
    ok = {}
    for k, (_, v) in enumerate(data):
        if v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            x = np.array(v, np.float64)
            ok[k] = x / np.linalg.norm(x)
    links = {(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= cosine}
    root = brute_components(range(len(data)), links)
    degree = [sum(k in p for p in links) for k in range(len(data))]
    return links, degree, root


@pytest.mark.parametrize("block", [2048, 40])
def test_forest_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(forest, "BLOCK", block)
    monkeypatch.setattr(forest, "LEAF", 64)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((500, 24))
    near = base[rng.integers(0, 60, 400)] + 0.12 * rng.standard_normal((400, 24))
    tight = base[0] + 0.05 * rng.standard_normal((150, 24))
    data = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(np.concatenate([base, near, tight, base[:5]]))]
    got = {r.id: (r.n_links, r.component_id) for r in forest.near_vectors(spark.createDataFrame(data, "vec_id bigint, embedding array<float>")).collect()}
    links, degree, root = slow_vectors(data, 0.95)
    assert len(got) == len(data)
    assert all(got[k][0] <= degree[k] for k in got)
    assert sum(n for n, _ in got.values()) >= 0.97 * 2 * len(links)
    assert np.mean([got[k][1] == root[k] for k in got]) >= 0.99


@pytest.mark.parametrize("block", [2048, 40])
def test_forest_finds_links_of_a_hot_cluster_at_depth(spark, monkeypatch, block):
    monkeypatch.setattr(forest, "BLOCK", block)
    monkeypatch.setattr(forest, "LEAF", 8)
    monkeypatch.setattr(forest, "SAMPLE_IN_LEAF", 4)
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.standard_normal((1800, 64)))
    x[:600] = np.sqrt(0.955) * x[0] + np.sqrt(0.045) * unit(rng.standard_normal((600, 64)))
    x = unit(x).astype(np.float32)
    exact = forest.unit_vectors(x)
    assert forest.fit(exact, len(x))[0].depth == 8
    degree = (exact @ exact.T >= 0.95).sum(axis=1) - 1
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r.id: r.n_links for r in forest.near_vectors(spark.createDataFrame(data, "vec_id bigint, embedding array<float>")).collect()}
    assert all(got[k] <= degree[k] for k in got) and sum(got.values()) >= 0.999 * degree.sum() > 100_000


def test_forest_small_table_is_exact_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]),
            (10, [1.0]), (None, [1.0, 0.01]), (12, [-1.0, 0.0]), (13, [1e30, 1e-30]), (14, [1e-40, 0.0])]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<float>")
    got = {r.id: (r.n_links, r.component_id) for r in forest.near_vectors(df).collect()}
    in_group = {1, 2, 3, None, 13, 14}
    assert {k: v for k, v in got.items() if k in in_group} == {k: (5, 1) for k in in_group}
    assert {k: v for k, v in got.items() if k not in in_group} == {k: (0, k) for k in (4, 5, 6, 7, 8, 9, 10, 12)}
    assert forest.near_vectors(df.limit(0)).count() == 0
    double = spark.createDataFrame([(1, [1e200, 1e200]), (2, [1e-200, 1e-200])], "vec_id bigint, embedding array<double>")
    assert [r.n_links for r in forest.near_vectors(double).collect()] == [1, 1]


def test_embeddings_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    data = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()]
    links, degree, root = slow_vectors(data, 0.95)
    got = {r.vec_id: r for r in queries.QUERIES["op3_embeddings"](spark, sf).collect()}
    assert [got[d].n_links for d, _ in data] == degree
    assert [got[d].component_id for d, _ in data] == [data[root[k]][0] for k in range(len(data))]
    assert all(got[d].kept == (got[d].component_id == d) for d, _ in data)
