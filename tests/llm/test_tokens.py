"""Tokenizer operators against the libraries and against plain Python."""

import functools
import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from plumbline.llm import alignment, bpe, queries

TEXTS = [
    "plain words, it's 12 o'clock!!", "", None, "  two  spaces \n\n\t and more\r\n ", "a<|endoftext|>b <|endoftext|><|endoftext|>",
    "漢字かな交じり \U0001f600\U0001f9ff ՘ \U00031350", "x" * 5000, "a long run of words " * 200 + "和" * 300, "''s !!'s 'S we'll", "ȩ́ Ünïcödé ﬁ ﷺ ①", "<s> </s> <unk> <0x41> ▁", "tail space ",
    " lead", "\x00\x01\x1c\x85", "plain words, it's 12 o'clock!!",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer("piece_bpe_32k.model"))


def _frame(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")


def test_encoding_is_the_library_s(spark, library):
    path = queries.tokenizer("byte_bpe_50k.json")
    rows = bpe.decoded(bpe.encoded(_frame(spark, TEXTS), path), path).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        text = TEXTS[r["doc_id"]] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["ids"] == ids, text
        assert r["decoded"] == library.decode(ids, skip_special_tokens=False) == text


@pytest.fixture(scope="module")
def spec():
    return bpe.read_vocabulary(queries.tokenizer("byte_bpe_50k.json"))


def test_special_strings_as_plain_text(library, spec):
    library.encode_special_tokens = True
    try:
        ids = bpe.Encoder(spec, special=False).encode(TEXTS).to_pylist()
        assert ids == [library.encode(t, add_special_tokens=False).ids if t else [] for t in TEXTS]
    finally:
        library.encode_special_tokens = False


@pytest.mark.parametrize("fragment", [1, 7, 100])
def test_every_certain_cut_may_be_used(library, spec, monkeypatch, fragment):
    monkeypatch.setattr(bpe, "FRAGMENT", fragment)
    encoder = bpe.Encoder(spec)
    texts = [t for t in TEXTS if t] + [r["text"] for r in _given() if r["text"]]
    n_cuts = 0
    for text, ids in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        pieces = encoder.fragments(text)
        assert "".join(pieces) == text
        n_cuts += len(pieces) - 1
        for left, right in zip(pieces, pieces[1:]):
            assert not encoder.pairs[left.encode()[-1], right.encode()[0]]
        assert encoder.ids(text) == ids.ids, text[:100]
    assert n_cuts > len(texts)


def _given():
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).to_pylist()


@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t\x85\u3000'srtvemld!?.,aZ09é漢Ж\U0001f600"), st.characters(exclude_categories=["Cs"])), max_size=60))
@settings(max_examples=400, deadline=None)
def test_any_text(text):
    encoder, library = _both()
    assert encoder.ids(text) == library.encode(text, add_special_tokens=False).ids
    at = [0, *encoder.cuts(text).tolist(), len(text)] if text else [0]
    assert [i for a, b in zip(at, at[1:]) for i in encoder._by_library(text[a:b])] == encoder._by_library(text)


@functools.cache
def _both():
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    return bpe.Encoder(bpe.read_vocabulary(path)), Tokenizer.from_file(path)


def test_decoding_of_odd_ids(spark, library):
    path = queries.tokenizer("byte_bpe_50k.json")
    rows = spark.createDataFrame([(1, [128], "x"), (2, None, "y"), (3, [-1, 99999], "z"), (4, [], None)], "k int, ids array<int>, decoded string")
    got = {r["k"]: r["decoded"] for r in bpe.decoded(rows, path).collect()}
    assert got == {1: library.decode([128]), 2: "", 3: "", 4: ""}


def test_refuses_other_vocabularies():
    with pytest.raises(ValueError):
        bpe.Encoder(bpe.read_vocabulary(queries.tokenizer("word_bpe_49k.json")))


def test_classes_agree_with_the_library(library, spec):
    """Every character that is encoded without the library, in the contexts that matter."""
    import unicodedata

    encoder = bpe.Encoder(spec)
    known = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.ucd_3_2_0.category(chr(c)) != "Cn"]
    for a in range(0, len(known), 4096):
        text = "".join(f"a{c}1{c}!{c} {c}{c}" for c in known[a : a + 4096])
        assert encoder._merge(text) == library.encode(text, add_special_tokens=False).ids


def test_steps_cover_all_rows():
    assert list(bpe.steps(np.array([5, 5, 100, 1, 1]), 10)) == [(0, 2), (2, 3), (3, 5)]
    assert list(bpe.steps(np.array([], np.int64), 10)) == []


def _plain_alignment(texts, library, pieces):
    """(n_a, n_b, groups, links) of each text, token by token."""
    library.encode_special_tokens = True
    at = {c: b for b, c in enumerate(bpe.alphabet())}
    names = {i: bytes(at[c] for c in t) for t, i in library.get_vocab(with_added_tokens=False).items()}
    out = []
    for text in texts:
        a = library.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        b_bytes = [bytes([int(pieces.id_to_piece(i)[3:-1], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or b"".join(names[i] for i in a) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            out.append((0, 0, [], []))
            continue
        groups, links, i, j, x, y, first = [], [], 0, 0, 0, 0, (0, 0)
        while i < len(a):
            if x <= y:
                x, i = x + len(names[a[i]]), i + 1
            while y < x:
                y, j = y + len(b_bytes[j]), j + 1
            if x == y:
                groups.append((a[first[0] : i], b[first[1] : j]))
                links.append((a[i - 1], b[j - 1]))
                first = (i, j)
        out.append((len(a), len(b), groups, links))
    library.encode_special_tokens = False
    return out


def _check_alignment(got, texts, library, pieces):
    plain = _plain_alignment(texts, library, pieces)
    counts = Counter(x for *_, links in plain for x in links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = []
    for n_a, n_b, groups, links in plain:
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        want.append((n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
                     hashlib.sha256(text.encode()).hexdigest() if text else ""))
    assert got == want


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("step_bytes", [40, 3_000_000])
def test_alignment_token_by_token(spark, library, pieces, tmp_path, monkeypatch, step_bytes):
    monkeypatch.setattr(alignment, "STEP_BYTES", step_bytes)
    _frame(spark, TEXTS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(queries.op11_alignment(spark, str(tmp_path)).collect(), key=lambda r: r["doc_id"])
    _check_alignment([tuple(r[c] for c in COLUMNS) for r in rows], TEXTS, library, pieces)


def test_alignment_of_given_documents(spark, library, pieces):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    rows = sorted(queries.op11_alignment(spark, "/root/testdata/sf0.001").collect(), key=lambda r: r["doc_id"])
    _check_alignment([tuple(r[c] for c in COLUMNS) for r in rows], texts, library, pieces)


def test_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    path, model = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model")
    for docs, n in ((odd_docs, odd_docs.count()), (no_docs, 0)):
        made = alignment.aligned(docs, path, model)
        assert alignment.with_counts(made.drop("groups")).count() == n
        assert bpe.decoded(bpe.encoded(docs, path), path).count() == n
    nothing_to_count = odd_docs.where("text IS NULL OR text = ''")
    lists = {r["doc_id"]: r["groups"] for r in alignment.aligned(odd_docs, path, model).collect() if r["doc_id"] == 1}
    text = {r["doc_id"]: r["groups"] for r in alignment.aligned(odd_docs, path, model, text_groups=True).collect()}
    assert text[1] == ";".join(f"{','.join(map(str, g['a']))}|{','.join(map(str, g['b']))}" for g in lists[1])
    rows = alignment.with_counts(alignment.aligned(nothing_to_count, path, model)).collect()
    assert [(r["n_links"], r["count_sum"], r["groups"]) for r in rows] == [(0, 0, [])] * 2
