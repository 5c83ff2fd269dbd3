"""Ranked search against a plain scoring of every document."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import sketches


def _plain(docs, items, k=10):
    """docs: (id, text) rows; items: (id, text) rows."""
    split = [(i, Counter(sketches.terms(t))) for i, t in docs]
    sized = [(i, c, sum(c.values())) for i, c in split]
    n_docs, n_terms = sum(n > 0 for *_, n in sized), sum(n for *_, n in sized)
    df = Counter(t for _, c, _ in sized for t in c)
    out = []
    for item in {i for i, _ in items}:
        asked = {t for i, text in items if i == item for t in sketches.terms(text)} & set(df)
        scores = []
        for i, c, n in sized:
            m = 10 + 90 * n * n_docs // n_terms if n else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def _got(spark, docs, items, k=10):
    found = sketches.search(
        spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(items, "item_id bigint, text string"), k
    )
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_terms():
    assert [t.decode() for t in sketches.terms("Ab1-c_D\x7fé É ÀB")] == ["ab1", "c", "d", "é", "É", "Àb"]
    assert sketches.terms(None) == sketches.terms(" -_") == []


@pytest.mark.parametrize("dimensions", [4, 1 << 16])
def test_same_ranks_as_scoring_everything(spark, monkeypatch, dimensions):
    """Also when nearly all terms share a coordinate and the bounds say little."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.randint(0, 40)))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(40)] + [(5, docs[5][1])] * 15 + [(5, "other text w3"), (None, docs[5][1]), (None, None), (7, "")]
    items = [(i, " ".join(rng.choices(words, k=8))) for i in range(12)] + [(3, "w59 more"), (None, "w1 w2"), (20, None), (21, "absent"), (22, "w0"), (22, "w0")]
    monkeypatch.setattr(sketches, "coordinate", lambda t: sketches.xxhash.xxh64_intdigest(t, 13) % dimensions)
    index = {t: sketches.coordinate(t) for t in (w.encode() for w in words)}
    assert (len(set(index.values())) <= 4) == (dimensions == 4)
    # workers import the module afresh: bounds are tried here, ranks through Spark
    block = sketches.Block.of([{w.encode(): 10 for w in rng.sample(words, 9)} for _ in range(5)])
    for _, text in docs[:50]:
        counts = Counter(sketches.terms(text))
        at, tf = sketches.sketch(counts)
        bound = block.bounds(np.array(at, np.int64), np.array(tf, np.int64), np.zeros(len(at), np.int64), np.array([17]))
        assert all(bound[0, q] >= block.score(q, counts, 17) for q in range(5))
        if dimensions > 4:
            assert all(bound[0, q] == block.score(q, counts, 17) for q in range(5))
    monkeypatch.undo()
    assert _got(spark, docs, items) == _plain(docs, items)


def test_blocks_of_queries_and_small_steps(spark, monkeypatch):
    monkeypatch.setattr(sketches, "QUERY_TERMS", 5)
    monkeypatch.setattr(sketches, "BROADCAST_ROWS", 0)
    docs = [(i, f"a{i % 3} b{i % 5} c{i % 7} d") for i in range(120)]
    items = [(i, f"a{i % 3} c{i % 7} z") for i in range(9)]
    assert _got(spark, docs, items, 4) == _plain(docs, items, 4)


def test_copies_of_the_best_text(spark):
    docs = [(i, "rare words here") for i in range(500, 0, -1)] + [(0, "words"), (600, "rare rare rare words here")]
    items = [(1, "rare words"), (2, "here")]
    assert _got(spark, docs, items) == _plain(docs, items)


def test_strings_as_ids_odd_and_empty_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "a b"), (2, "")], "item_id int, text string")
    assert sketches.search(no_docs, items).count() == 0
    assert sketches.search(odd_docs, items.limit(0)).count() == 0
    rows = sketches.search(odd_docs, items).collect()
    assert [(r["item_id"], r["doc_id"]) for r in rows] == [(1, 1), (1, 1)]
    named = odd_docs.selectExpr("concat('d', doc_id) AS doc_id", "text")
    assert [r["doc_id"] for r in sketches.search(named, items).collect()] == ["d1", "d1"]
