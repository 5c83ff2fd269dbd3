"""Byte-level BPE by forced-boundary splitting, and its exact inverse.

A merge joins two neighbours into a token of the vocabulary, so a pair of bytes that
stands inside no token is never merged across: between such bytes lies a certain cut. Of
these, a text is cut where the vocabulary's pattern cannot look across either (see
``Encoder.cuts``); each fragment is encoded independently of all others and the ids are
concatenated. The result is what the library gives for the whole text.

A text of any length is so encoded in pieces of about ``FRAGMENT`` characters. Nothing is
shuffled, and memory is a few times the bytes of a step.
"""

from __future__ import annotations

import functools
import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

#: The published pattern of this family of vocabularies, and the bytes
#: that stand for themselves in its files (all others are written as 256 and up).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_PLAIN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: A fragment ends at the first certain cut after so many characters. Every certain cut may
#: be used; one per fragment costs a call.
FRAGMENT = 1_000
#: Bytes of text that are encoded at a time.
STEP_BYTES = 1_000_000


def alphabet() -> list[str]:
    """The character that stands for each byte."""
    plain = set(_PLAIN_BYTES)
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@functools.cache
def _recent(char: str) -> bool:
    """Whether a character is younger than Unicode 3.2. Libraries differ on the class of
    such characters only; fragments that hold one are encoded by the vocabulary's own library."""
    return unicodedata.ucd_3_2_0.category(char) == "Cn"


#: Which code points are white space; none lies beyond.
_WHITE = np.array([chr(c).isspace() for c in range(0x3001)] + [False])


def _end_bytes(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) byte of each code point in UTF-8."""
    first = np.select(
        [code < 0x80, code < 0x800, code < 0x10000], [code, 0xC0 | code >> 6, 0xE0 | code >> 12], 0xF0 | code >> 18
    )
    return first, np.where(code < 0x80, code, 0x80 | code & 0x3F)


class Encoder:
    """Encodes and decodes with one byte-level vocabulary file, given as its text.

    ``special``: whether special tokens that occur in a text get their own id; else
    their strings are plain text.
    """

    def __init__(self, spec: str, special: bool = True):
        import tiktoken

        parts = json.loads(spec)
        splitter, model = parts["pre_tokenizer"] or {}, parts["model"]
        added = parts["added_tokens"]
        if (
            splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True)
            or parts["normalizer"] or model["type"] != "BPE" or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        ):
            raise ValueError("not a plain byte-level BPE vocabulary")
        byte_of = {ord(c): b for b, c in enumerate(alphabet())}
        ranks = {t.translate(byte_of).encode("latin-1"): i for t, i in model["vocab"].items()}
        if [ranks[x.translate(byte_of).encode("latin-1")] for x in map("".join, model["merges"])] != sorted(set(ranks.values()))[256 : 256 + len(model["merges"])]:
            raise ValueError("the ids are not in the order of the merges")
        self.pairs = np.zeros((256, 256), bool)  # pairs that stand inside a token
        for token in ranks:
            at = np.frombuffer(token, np.uint8)
            self.pairs[at[:-1], at[1:]] = True
        self._merge = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._spec, self._library = spec, None
        self._special = {t["content"]: t["id"] for t in added if special}
        contents = sorted(self._special, key=len, reverse=True)
        self._split = regex.compile(f"({'|'.join(map(regex.escape, contents))})") if contents else None

    def _by_library(self, text: str) -> list[int]:
        if self._library is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task per core
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self._spec)
            self._library.encode_special_tokens = True
        return self._library.encode(text, add_special_tokens=False).ids

    def cuts(self, text: str) -> np.ndarray:
        """Places between two characters where a text may be cut: their bytes stand side by
        side in no token, and the pattern reads both sides as it reads the whole.

        It does so unless white space stands before the cut (the pattern joins a space to
        what follows, and looks ahead from white space), or an apostrophe behind it (at
        the start of a fragment it may begin a contraction). The pattern looks ahead
        nowhere else and never back, and all pairs inside contractions are in tokens.
        """
        if text.isascii():
            code = first = last = np.frombuffer(text.encode(), np.uint8)
        else:
            code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            first, last = _end_bytes(code)
        white = _WHITE[code if text.isascii() else np.minimum(code, len(_WHITE) - 1)]
        return np.flatnonzero(~self.pairs[last[:-1], first[1:]] & (code[1:] != ord("'")) & ~white[:-1]) + 1

    def fragments(self, text: str) -> list[str]:
        """The text in pieces of at least ``FRAGMENT`` characters (but for the last) that end at a cut."""
        if len(text) <= FRAGMENT:
            return [text] if text else []
        at, found, start = self.cuts(text), [], 0
        while (k := int(np.searchsorted(at, start + FRAGMENT))) < len(at):
            found.append(text[start : at[k]])
            start = int(at[k])
        return [*found, text[start:]]

    def _plain(self, text: str) -> list[int]:
        ids: list[int] = []
        for piece in self.fragments(text):
            plain = piece.isascii() or not any(map(_recent, set(piece)))
            ids += self._merge(piece) if plain else self._by_library(piece)
        return ids

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self._split is None or not any(t in text for t in self._special):
            return self._plain(text)
        pieces = self._split.split(text)
        return [i for k, piece in enumerate(pieces) for i in ([self._special[piece]] if k % 2 else self._plain(piece))]

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of every text."""
        each = [np.array(self.ids(t), np.int32) for t in texts]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in each], dtype=np.int64)))
        flat = np.concatenate(each) if each else np.empty(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


@functools.lru_cache(maxsize=4)
def token_bytes(spec: str) -> pa.Array:
    """The bytes of every id of a byte-level vocabulary, special tokens included."""
    parts = json.loads(spec)
    byte_of = {ord(c): b for b, c in enumerate(alphabet())}
    names = {i: t.translate(byte_of).encode("latin-1") for t, i in parts["model"]["vocab"].items()}
    names |= {t["id"]: t["content"].encode() for t in parts["added_tokens"]}
    return pa.array([names.get(i, b"") for i in range(max(names) + 1)], pa.binary())


def decode(ids: pa.ListArray, names: pa.Array) -> pa.StringArray:
    """The text of every list of ids, ``names`` being the bytes of each id; bytes that are
    no UTF-8 become U+FFFD, a null list and ids that are not in the vocabulary nothing."""
    flat, offsets = ids.flatten(), ids.offsets
    offsets = pc.subtract(offsets, offsets[0])
    known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(names)))
    pieces = pc.fill_null(names.take(pc.if_else(known, flat, None)), b"")
    joined = pc.binary_join(pa.ListArray.from_arrays(offsets, pieces), b"")
    try:
        return joined.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.as_py().decode("utf-8", "replace") for x in joined], pa.string())


def steps(lengths: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of consecutive rows of about ``most`` in total, one row at least."""
    upto = np.cumsum(lengths)
    a = 0
    while a < len(upto):
        before = upto[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(upto, before + most, "right")))
        yield a, b
        a = b


@functools.lru_cache(maxsize=4)
def shared_encoder(spec: str, special: bool) -> Encoder:
    """One encoder per worker process and vocabulary."""
    return Encoder(spec, special)


def read_vocabulary(path: str) -> str:
    """The vocabulary file (about 2 MB), read by the driver and sent with the tasks."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encoded(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", special: bool = True) -> DataFrame:
    """(doc_id, ids): the ids of every whole text, one row per row of ``docs``.

    ``vocabulary`` is the path of a tokenizer file. Null and empty texts have no ids;
    null and repeated document ids and repeated rows are rows like any other.
    """
    spec = read_vocabulary(vocabulary)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(spec, special)
        for batch in batches:
            for a, b in steps(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), encoder.encode(part.column(1).to_pylist())], ["doc_id", "ids"])

    kind = docs.select(id_col).dtypes[0][1]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(apply, f"doc_id {kind}, ids array<int>")


def decoded(rows: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` (with a column ``ids`` and any others) and ``decoded``, the text of the
    ids, special tokens included. Replaces a column named ``decoded``. Null lists give an empty text."""
    spec = read_vocabulary(vocabulary)
    kept = [c for c in rows.columns if c != "decoded"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = token_bytes(spec)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            for a, b in steps(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)):
                part = batch.slice(a, b - a)
                text = decode(ids.slice(a, b - a), names)
                yield pa.RecordBatch.from_arrays([*part.columns, text], [*kept, "decoded"])

    narrow = rows.select(*kept)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields)
    return narrow.mapInArrow(apply, f"{fields}, decoded string")
