"""SimHash near-duplicates, compared at the anchors of a covering code.

Fingerprints of 64 bits link at ``THRESHOLD`` = 3 or fewer differing bits. Two
parts of 31 bits are looked at in turn; three differing bits leave at most one
in one of the parts. On a part, the codewords of the perfect Hamming code
(31, 26) are the anchors: every 31-bit word lies within the covering radius 1 of
exactly one, its home. Each fingerprint is replicated to every anchor within
covering radius plus threshold, 1 + 1 = 2, which are 1 or 16 codewords, and is
compared there with the fingerprints at home at that anchor. A pair that differs
in at most one bit of the part meets at the home of either, so no link is lost.

Equal fingerprints are folded before anything is replicated. An anchor with many
different fingerprints (a large group of near copies) is compared in blocks of
bounded size, which give back one link per fingerprint instead of all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import durable
from .components import smallest_ids
from .words import Words

THRESHOLD = 3
SHINGLE = 3
SEED = 42
PART_BITS = 31
PARTS = 2
#: An anchor at which more different fingerprints are at home is compared in blocks.
CROWD = 32
#: Fingerprints of either side in one block: a comparison of 4 million pairs.
BLOCK = 2048
#: Up to so many crowded anchors (8 bytes each) are broadcast; more are joined.
BROADCAST_ANCHORS = 1_000_000

_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def _majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes. Each of the 8 bytes
    of a hash is spread to 8 one-byte counters of a word; 255 such words can be
    added before a counter overflows."""
    n = len(hashes)
    if not n:
        return 0
    groups = np.arange(0, n, 255)
    columns = hashes.astype("<u8", copy=False).view(np.uint8).reshape(n, 8)
    fingerprint = 0
    for byte in range(8):
        sums = np.add.reduceat(_LANES[columns[:, byte]], groups)
        counts = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for bit in range(8):
            if 2 * counts[bit] > n:
                fingerprint |= 1 << (8 * byte + bit)
    return fingerprint


def fingerprint(text: str | None) -> int:
    """SimHash of the 3-word shingles of the ASCII-lower-cased text, repeats
    included; of the whole sequence when it is shorter, zero without words."""
    words = Words(text, lower=True)
    return _majority(words.run_hashes(min(SHINGLE, max(words.n, 1)), SEED))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, fp): one row per document; t is a hash of the text, fp the
    fingerprint as a signed long with the same bits."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.fromiter((fingerprint(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits.view(np.int64))], ["id", "t", "fp"])

    named = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    return named.mapInArrow(fold, "id bigint, t bigint, fp bigint")


def _differing(a: Column | str, b: Column | str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _parts(prints: DataFrame) -> DataFrame:
    """(fp, part, x, s): the 31 bits of each part and their Hamming syndrome, the
    position (1 to 31) whose flip gives a codeword, 0 for a codeword."""
    mask = (1 << PART_BITS) - 1
    parts = [
        F.struct(F.lit(p).alias("part"), F.shiftrightunsigned("fp", PART_BITS * p).bitwiseAND(F.lit(mask)).alias("x"))
        for p in range(PARTS)
    ]
    checks = [sum(1 << (i - 1) for i in range(1, PART_BITS + 1) if i >> c & 1) for c in range(5)]
    syndrome = sum(
        ((F.bit_count(F.col("x").bitwiseAND(F.lit(m))) % 2) * (1 << c) for c, m in enumerate(checks)), F.lit(0)
    )
    return (
        prints.select("fp", F.explode(F.array(*parts)).alias("p")).select("fp", "p.part", "p.x").withColumn("s", syndrome)
    )


_HOME = "IF(s = 0, x, x ^ shiftleft(1L, s - 1))"


def homes(prints: DataFrame) -> DataFrame:
    """(anchor, home): each fingerprint at the anchor it lies within radius 1 of."""
    return _parts(prints).select(F.expr(f"2 * ({_HOME}) + part").alias("anchor"), F.col("fp").alias("home"))


def visits(prints: DataFrame) -> DataFrame:
    """(anchor, guest): each fingerprint at all anchors within distance 2."""
    pairs = f"transform(filter(sequence(1, {PART_BITS}), i -> i < (i ^ s)), i -> x ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s) - 1))"
    near = F.expr(f"concat(array({_HOME}), {pairs})")
    return (
        _parts(prints).select("fp", "part", F.explode(near).alias("word"))
        .select(F.expr("2 * word + part").alias("anchor"), F.col("fp").alias("guest"))
    )


def _local_links(table):
    """Links of one block: each fingerprint with the first one of the same local
    component. Both sides take the smallest label across their links until none changes."""
    fp, is_home = table.column("fp").to_numpy(), table.column("is_home").to_numpy(zero_copy_only=False)
    at_home, guests = np.unique(fp[is_home]).view(np.uint64), np.unique(fp[~is_home]).view(np.uint64)
    near = np.bitwise_count(at_home[:, None] ^ guests[None, :]) <= THRESHOLD
    none = len(at_home)
    label = np.arange(none)
    while True:
        of_guest = np.where(near, label[:, None], none).min(axis=0, initial=none)
        new = np.minimum(label, np.where(near, of_guest[None, :], none).min(axis=1, initial=none))
        if (new == label).all():
            break
        label = new
    linked = of_guest < none
    a = np.concatenate([at_home, guests[linked]]).view(np.int64)
    b = np.concatenate([at_home[label], at_home[of_guest[linked]]]).view(np.int64)
    return pa.table({"a": a[a != b], "b": b[a != b]})


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """(a, b): links that connect all fingerprints (distinct, column ``fp``)
    which a chain of steps of at most 3 bits connects."""
    at_home, guests = homes(prints), visits(prints)
    crowded = durable(at_home.groupBy("anchor").agg(F.count(F.lit(1)).alias("n_home")).where(F.col("n_home") > CROWD))
    n_crowded = crowded.count()
    keys = crowded if n_crowded > BROADCAST_ANCHORS else F.broadcast(crowded)  # 16 bytes a row, counted just before

    few = guests.join(keys, "anchor", "left_anti").join(at_home.join(keys, "anchor", "left_anti"), "anchor")
    links = few.where((F.col("home") != F.col("guest")) & (_differing("home", "guest") <= THRESHOLD)).select(
        F.col("home").alias("a"), F.col("guest").alias("b")
    )
    if not n_crowded:
        return links

    n_guest = guests.join(keys, "anchor").groupBy("anchor", "n_home").agg(F.count(F.lit(1)).alias("n_guest"))
    sizes = durable(n_guest.select(
        "anchor", F.ceil(F.col("n_home") / BLOCK).cast("int").alias("gh"), F.ceil(F.col("n_guest") / BLOCK).cast("int").alias("gg")
    ))
    sizes = sizes if n_crowded > BROADCAST_ANCHORS else F.broadcast(sizes)

    def dealt(side: DataFrame, column: str, is_home: bool) -> DataFrame:
        own, other = ("gh", "gg") if is_home else ("gg", "gh")
        block = F.pmod(F.xxhash64(column), F.col(own)).cast("int")
        everywhere = F.explode(F.expr(f"sequence(0, {other} - 1)"))
        return side.join(sizes, "anchor").select("anchor", F.col(column).alias("fp"), block.alias("mine"), everywhere.alias("theirs")).select(
            "anchor", "fp", F.lit(is_home).alias("is_home"),
            (F.col("mine") if is_home else F.col("theirs")).alias("i"), (F.col("theirs") if is_home else F.col("mine")).alias("j"),
        )

    blocks = dealt(at_home, "home", True).unionByName(dealt(guests, "guest", False))
    return links.unionByName(blocks.groupBy("anchor", "i", "j").applyInArrow(_local_links, "a bigint, b bigint"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, fp, component_id): one row per document; t is a hash of the text.

    ``component_id`` is the smallest id reachable over links, the document itself
    included. Null and empty texts have the fingerprint zero, which links like any
    other. A null id takes part and comes back as null; a component without any
    other id has a null ``component_id``. Repeated rows come back repeated.
    """
    prints = durable(fingerprints(docs, id_col, text_col))
    folded = durable(prints.groupBy(F.col("fp").alias("node")).agg(F.min("id").alias("first_id")))
    named = durable(smallest_ids(folded, fingerprint_links(folded.select(F.col("node").alias("fp")))))
    return prints.join(named, prints["fp"] == named["node"]).select("id", "t", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id.

    Of rows that share this id, one stays: that with the smallest text hash, then the
    least in the order of its other columns (nulls first; maps are not compared). Components in which all ids are null
    can not be told apart by id: there one row of each different text stays.
    """
    found = simhash_components(docs, id_col, text_col).where(F.col("id").eqNullSafe(F.col("component_id")))
    stay = found.groupBy("id", F.when(F.col("id").isNull(), F.col("t")).alias("own")).agg(F.min("t").alias("t")).select(
        F.col("id").alias("stay_id"), F.col("t").alias("stay_t")
    )
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("t"))
    kept = keyed.join(stay, F.col("id").eqNullSafe(F.col("stay_id")) & (F.col("t") == F.col("stay_t")), "left_semi")
    ordered = [f.name for f in docs.schema.fields if f.name != text_col and not re.search("map<|variant|interval", f.dataType.simpleString())]
    number = F.row_number().over(Window.partitionBy("id", "t").orderBy(*([F.col("row").getField(c) for c in ordered] or [F.lit(0)])))
    return kept.withColumn("number", number).where("number = 1").select("row.*")
