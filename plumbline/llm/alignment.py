"""Alignment of the tokens that two tokenizers give one text, in Arrow inside tasks.

A is a byte-level BPE vocabulary, B a sentencepiece model; both encode the text behind
one space (B adds it itself). Tokens are ranges of bytes. Where a token of A and one of
B end together the text is cut: what lies between two cuts is a *group*, and the two
tokens that end there are a *link*.

Within a batch everything is a column. The lists of ids are flattened and the indices of
their parents kept; byte lengths looked up by id and summed up within each parent give
the ends; an Acero hash join on (document, end) gives the links; the groups are lists
whose offsets are the places of the links. ``Table.group_by`` counts each distinct
pair of ids once per batch, and Spark merges these partial counts.

A document then refers to its pairs by their number in its batch, so the counts of the
corpus come back as one short table per batch: a hot pair is one row per batch, and no row
is made per token anywhere in Spark. A batch holds about ``STEP_BYTES`` of text.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import durable_table
from .bpe import read_vocabulary, shared_encoder, steps, token_bytes

#: Bytes of text in a batch.
STEP_BYTES = 1_000_000


@functools.lru_cache(maxsize=2)
def _pieces(model: bytes):
    """(processor, bytes of every id) of a sentencepiece model."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return sp, pa.array(
        [bytes([int(n[3:-1], 16)]) if sp.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)], pa.binary()
    )


def _lists(flat: pa.Array, sizes: pa.Array) -> pa.ListArray:
    """The lists of given sizes that ``flat`` is cut into."""
    ends = pc.cumulative_sum(sizes.cast(pa.int32()))
    return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), flat)


def _sizes(ids: pa.ListArray, keep: pa.Array) -> pa.ListArray:
    """``ids`` with empty lists where ``keep`` is false."""
    kept = ids.flatten().filter(keep.take(pc.list_parent_indices(ids).cast(pa.int64())))
    return _lists(kept, pc.if_else(keep, pc.list_value_length(ids), 0))


def _ends(ids: pa.ListArray, lengths: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(document, end in bytes) of every token: a cumulative sum that starts anew in
    each document, by taking off what had come before it."""
    parents = pc.list_parent_indices(ids).cast(pa.int32())
    upto = pc.cumulative_sum(lengths.take(ids.flatten()))
    before = pa.concat_arrays([pa.array([0], pa.int64()), upto]).take(ids.offsets.slice(0, len(ids)))
    return parents, pc.subtract(upto, before.take(parents))


def _joined(ids: pa.ListArray, names: pa.Array) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(ids.offsets, names.take(ids.flatten())), b"")


def align(a: pa.ListArray, b: pa.ListArray, a_bytes: pa.Array, b_bytes: pa.Array, whole: pa.Array) -> tuple[pa.Array, pa.Array, pa.Table]:
    """(n_a, groups, links) of the ids of some texts, given as bytes in ``whole`` (null: no
    tokens). ``links`` is a table (doc, a_at, b_at, a, b) in order of the text; documents
    whose tokens do not join to ``whole`` have no tokens."""
    same = pc.and_(pc.equal(_joined(a, a_bytes), whole), pc.equal(_joined(b, b_bytes), whole))
    same = pc.fill_null(same, False)
    a, b = _sizes(a, same), _sizes(b, same)
    tables = []
    for name, ids, names in (("a", a, a_bytes), ("b", b, b_bytes)):
        doc, end = _ends(ids, pc.binary_length(names).cast(pa.int64()))
        tables.append(pa.table({"doc": doc, "end": end, f"{name}_at": pa.array(np.arange(len(doc)), pa.int32())}))
    ends = tables[0].join(tables[1], ["doc", "end"], join_type="inner", use_threads=False).select(["doc", "a_at", "b_at"]).combine_chunks()
    ends = ends.take(pc.sort_indices(ends["a_at"]))
    links = ends.append_column("a", a.flatten().take(ends["a_at"])).append_column("b", b.flatten().take(ends["b_at"]))
    groups = pa.StructArray.from_arrays(
        [_lists(ids.flatten(), _gaps(links[f"{name}_at"])) for name, ids in (("a", a), ("b", b))], ["a", "b"]
    )
    n_links = np.bincount(links["doc"].to_numpy(), minlength=len(a))
    return pa.StructArray.from_arrays([pc.list_value_length(a), pc.list_value_length(b)], ["a", "b"]), _lists(groups, pa.array(n_links)), links


def _gaps(places: pa.ChunkedArray) -> pa.Array:
    """Sizes of the runs of tokens that end at the given places."""
    at = places.to_numpy()
    return pa.array(np.diff(at, prepend=-1))


_PAIRS = "array<struct<a: int, b: int, n: bigint>>"


def as_text(groups: pa.ListArray) -> pa.Array:
    """Groups as ``a1,a2|b1;a3|b2,b3``: the ids of A and of B of each group, in order."""
    sides = []
    for name in "ab":
        ids = pc.struct_field(groups.flatten(), name)
        sides.append(pc.binary_join(pa.ListArray.from_arrays(ids.offsets, ids.flatten().cast(pa.string())), ","))
    return pc.binary_join(pa.ListArray.from_arrays(groups.offsets, pc.binary_join_element_wise(*sides, "|")), ";")


def aligned(docs: DataFrame, vocabulary: str, model: str, id_col: str = "doc_id", text_col: str = "text", text_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, groups, n_groups, batch, links, pairs): one row per row of ``docs``.

    ``vocabulary`` and ``model`` are paths of tokenizer files, read by the driver (about
    2 MB) and sent with the tasks. ``groups`` is an array of (a: ids, b: ids) in order of
    the text, or with ``text_groups`` one string (see ``as_text``), which is less to move, beside
    ``n_groups``. ``links`` has one number per link: which of the ``pairs`` (a, b, n) of its
    batch it is; ``pairs`` stands on the first row of each batch and counts every
    distinct pair once. Strings of special tokens are plain text. Null and empty texts, and
    texts that either tokenizer does not give back byte by byte, have no tokens.
    Null ids, repeated ids and repeated rows are rows like any other.
    """
    spec = read_vocabulary(vocabulary)
    with open(model, "rb") as file:
        proto = file.read()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, a_bytes = shared_encoder(spec, False), token_bytes(spec)
        sp, b_bytes = _pieces(proto)
        part_no, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for first, last in steps(sizes, STEP_BYTES):
                part = batch.slice(first, last - first)
                texts = [t or "" for t in part.column(1).to_pylist()]
                spaced = [" " + t if t else "" for t in texts]
                a = encoder.encode(spaced)
                b = pa.array(sp.encode(texts, num_threads=1), pa.list_(pa.int32()))
                whole = pa.array([t.encode("utf-8", "surrogatepass") if t else None for t in spaced], pa.binary())
                sizes_of, groups, found = align(a, b, a_bytes, b_bytes, whole)
                pairs = found.group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")])
                names = ["a", "b", "count_all"]
                pairs = pairs.append_column("i", pa.array(np.arange(len(pairs)), pa.int32()))
                links = found.join(pairs.select(["a", "b", "i"]), ["a", "b"], join_type="inner", use_threads=False).sort_by("a_at")["i"]
                listed = pa.StructArray.from_arrays([pairs[c].combine_chunks() for c in names], ["a", "b", "n"])
                of_first = pa.array([0] + [len(listed)] * len(part), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0), sizes_of.field("a"), sizes_of.field("b"), as_text(groups) if text_groups else groups,
                        pc.list_value_length(groups), pa.array([f"{part_no}-{k}"] * len(part)),
                        pa.ListArray.from_arrays(groups.offsets, links.combine_chunks()),
                        pa.ListArray.from_arrays(of_first, listed, mask=pa.array(np.arange(len(part)) > 0)),
                    ],
                    ["doc_id", "n_a", "n_b", "groups", "n_groups", "batch", "links", "pairs"],
                )
                k += 1

    kind = docs.select(id_col).dtypes[0][1]
    groups = "string" if text_groups else "array<struct<a: array<int>, b: array<int>>>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        apply, f"doc_id {kind}, n_a int, n_b int, groups {groups}, n_groups int, batch string, links array<int>, pairs {_PAIRS}"
    )


def pair_counts(written: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``aligned`` rows that are kept (a table or checkpoint): the partial counts
    (of_batch, i, a, b, n), and of each pair (a, b, count, best): how many links of the corpus
    have it, and whether no other pair of the same b has more."""
    partial = written.where("pairs IS NOT NULL").select(
        F.col("batch").alias("of_batch"), F.posexplode("pairs").alias("i", "p")
    ).select("of_batch", "i", "p.*")
    counts = partial.groupBy("a", "b").agg(F.sum("n").alias("count"))
    highest = counts.groupBy("b").agg(F.max("count").alias("most")).withColumnRenamed("b", "b2")
    return partial, counts.join(highest, F.col("b") == F.col("b2")).select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def with_counts(made: DataFrame) -> DataFrame:
    """Adds ``n_links``, ``n_best`` and ``count_sum`` to ``aligned`` rows (any columns
    beside ``batch``, ``links`` and ``pairs``, which go): links of the document, those whose
    pair no other pair of the same b exceeds in the corpus, and the sum of their counts.

    ``made`` is written to the checkpoint folder first, so the numbers of a batch stay the
    same for all later reads. Leave out ``groups`` before if they are not needed after.
    """
    written = durable_table(made)
    partial, counts = pair_counts(written)
    judged = partial.join(counts.withColumnsRenamed({"a": "a2", "b": "b2"}), (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2"))).select(
        "of_batch", "i", "count", "best"
    )
    own = [c for c in written.columns if c not in ("batch", "links", "pairs", "n_links", "n_best", "count_sum")]

    def apply(rows: pa.Table, pairs: pa.Table) -> pa.Table:
        count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        at = pairs["i"].to_numpy()
        count[at], best[at] = pairs["count"].to_numpy(), pairs["best"].to_numpy().astype(np.int64)
        rows = rows.combine_chunks()
        links = rows["links"].combine_chunks() if isinstance(rows["links"], pa.ChunkedArray) else rows["links"]
        flat, offsets = links.flatten().to_numpy(), links.offsets.to_numpy() - links.offsets[0].as_py()
        sums = [np.diff(np.concatenate(([0], np.cumsum(values[flat])))[offsets]) for values in (best, count)]
        out = rows.select(own)
        for name, values in zip(("n_links", "n_best", "count_sum"), (np.diff(offsets).astype(np.int64), *sums)):
            out = out.append_column(name, pa.array(values, pa.int64()))
        return out

    kept = written.select(*own, "batch", "links")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.select(*own).schema.fields)
    return kept.groupBy("batch").cogroup(judged.groupBy("of_batch")).applyInArrow(apply, f"{fields}, n_links bigint, n_best bigint, count_sum bigint")
