"""Near-duplicate embeddings with a forest of random-projection trees.

Each tree splits the vectors again and again at the median of their projections
on a random direction. Vectors within ``SPILL`` of the cut, by rank, go to both
sides, so that close vectors are seldom parted; ``TREES`` trees with other
directions make up for those that are. The cut leaves the median, the direction is
drawn anew and the spill grows where more links would be parted than ``MISSED``
allows at this depth; a node that no such cut divides (a dense cluster) becomes a
leaf. Vectors are compared inside the leaves only, by exact cosine in double precision.

A pair that meets in several leaves counts in the first of them: each vector
carries the numbers of its leaves, and a leaf passes over pairs that share a
smaller one. Vectors that share an undivided cluster are not even compared again
in later trees. A leaf gives back a count per vector and one link per vector to its
local component, never its pairs. Equal vectors are folded first.

The trees are fitted on a bounded sample and applied to every vector. A leaf that
holds more than ``BLOCK`` vectors (beyond what the sample can split) is compared
in pairs of blocks, so nothing is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, exp, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .components import smallest_ids

COSINE = 0.95
TREES = 8
#: Ranks around the cut that go to both sides: from cut - SPILL to cut + SPILL; wider where that parts too many links.
SPILL = 0.05
SPILLS = (SPILL, 0.075, 0.1)
#: Ranks at which a node may be cut, and directions tried, in this order.
CUTS = (0.5, 0.45, 0.55, 0.4, 0.6, 0.35, 0.65, 0.3, 0.7, 0.25, 0.75)
DIRECTIONS = 4
#: Share of links at exactly the cosine asked for that all trees together may part.
MISSED = 0.001
#: Vectors a leaf should hold.
LEAF = 512
#: Rows of the sample the trees are fitted on (256 bytes each for 64 floats), and of it in a leaf at least.
SAMPLE = 32_768
SAMPLE_IN_LEAF = 16
#: Vectors of a leaf compared at once on either side.
BLOCK = 2048


def unit_vectors(values: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so nothing overflows."""
    x = values.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _parted(gap: float, distance: float) -> float:
    """Expected excess over ``gap`` of a normal difference with deviation ``distance``."""
    z = gap / distance
    return 2 * distance * (exp(-z * z / 2) / sqrt(2 * pi) - z * (1 - erf(z / sqrt(2))) / 2)


def _cut(at: np.ndarray, distance: float, allowed: float) -> tuple[float, float] | None:
    """The first (low, high) that parts at most ``allowed`` of the links around the
    cut: the density of rows there times what a link reaches beyond the gap."""
    at = np.sort(at)
    for spill in SPILLS:
        for cut in CUTS:
            low, high = np.quantile(at, (cut - spill, cut + spill))
            if high > low and 2 * spill / (high - low) * _parted(high - low, distance) <= allowed:
                return low, high
    return None


class Tree:
    """Directions and the two cuts of every inner node, in heap order. ``whole``
    has the leaves of nodes that were not divided further."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int, cosine: float, trees: int):
        rng = np.random.default_rng(seed)
        inner, dim = (1 << depth) - 1, sample.shape[1]
        self.depth = depth
        self.directions = rng.standard_normal((inner, dim)).astype(np.float32)
        self.low, self.high = np.full(inner, np.inf), np.full(inner, np.inf)  # everything goes left
        self.whole = []
        allowed = 1 - (1 - MISSED ** (1 / trees)) ** (1 / max(depth, 1))
        link = sqrt(max(2 - 2 * cosine, 1e-12) / dim)
        rows = {0: np.arange(len(sample))}
        for node in range(inner):
            own = rows.pop(node, None)
            if own is None:
                continue
            found = None
            for _ in range(DIRECTIONS if len(own) > 1 else 0):
                direction = self.directions[node].astype(np.float64)
                at = sample[own] @ direction
                found = _cut(at, link * np.linalg.norm(direction), allowed)
                if found:
                    break
                self.directions[node] = rng.standard_normal(dim)
            if not found:
                level = (node + 1).bit_length() - 1
                self.whole.append(((node + 1) << (depth - level)) - (1 << depth))
                continue
            self.low[node], self.high[node] = found
            rows[2 * node + 1], rows[2 * node + 2] = own[at <= self.high[node]], own[at >= self.low[node]]

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that each row of ``x`` falls in."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            at = np.einsum("ij,ij->i", x[row], self.directions[node].astype(np.float64))
            left, right = at <= self.high[node], at >= self.low[node]
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
        return row, node - ((1 << self.depth) - 1)


def fit(sample: np.ndarray, n_vectors: int, trees: int = TREES, seed: int = 42, cosine: float = COSINE) -> list[Tree]:
    depth = 0
    while n_vectors > LEAF << depth and len(sample) >= SAMPLE_IN_LEAF << (depth + 1):
        depth += 1
    return [Tree(sample, depth, seed + t, cosine, trees) for t in range(trees if depth else 1)]


def _matrix(column: pa.Array, dim: int, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim)


def _routed(models: dict[int, list[Tree]], kind: type):
    """Each vector once per leaf: (leaf, first, node, copies, vector, leaves); ``first`` is
    its first undivided cluster when that comes before the leaf, else -1."""
    whole = {dim: np.array([w + (t << tree.depth) for t, tree in enumerate(of) for w in tree.whole], np.int64) for dim, of in models.items()}

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            dims = np.diff(lists.offsets.to_numpy())
            flat, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                values = np.stack([flat[starts[i] : starts[i] + dim] for i in own]).astype(kind, copy=False)
                x = unit_vectors(values)
                found = []
                for number, tree in enumerate(models[dim]):
                    row, leaf = tree.leaves(x)
                    found.append((row, leaf + (number << tree.depth)))
                row, leaf = (np.concatenate(p) for p in zip(*found))
                order = np.lexsort((leaf, row))
                row, leaf = row[order], leaf[order]
                cut = np.searchsorted(row, np.arange(len(own) + 1))
                codes = leaf.astype(np.int32)
                first = np.full(len(own), np.iinfo(np.int32).max)
                is_whole = np.isin(leaf, whole[dim])
                np.minimum.at(first, row[is_whole], leaf[is_whole])
                first = np.where(first[row] < leaf, first[row], -1).astype(np.int32)
                lists_of = [codes[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                packed = [v.tobytes() for v in values]
                at = pa.array(own[row])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), dim, np.int32)), pa.array(codes), pa.array(first), batch.column(0).take(at), batch.column(1).take(at),
                     pa.array([packed[i] for i in row.tolist()], pa.binary()), pa.array([lists_of[i] for i in row.tolist()], pa.binary())],
                    ["dim", "leaf", "first", "node", "copies", "vector", "leaves"])

    return route


_ROUTED = "dim int, leaf int, first int, node bigint, copies bigint, vector binary, leaves binary"


def _first_meeting(a: list[bytes], b: list[bytes], leaf: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of the pairs (a[i], b[j]), those that share no leaf before ``leaf``."""

    def members(rows: list[bytes], used: np.ndarray) -> list[np.ndarray]:
        found = [np.frombuffer(rows[k], np.int32) for k in used.tolist()]
        return [x[x < leaf] for x in found]

    ui, at_i = np.unique(i, return_inverse=True)
    uj, at_j = np.unique(j, return_inverse=True)
    of_a, of_b = members(a, ui), members(b, uj)
    codes = np.unique(np.concatenate([np.empty(0, np.int32), *of_a, *of_b]))
    if not len(codes):
        return np.ones(len(i), bool)

    def table(rows: list[np.ndarray]) -> np.ndarray:
        m = np.zeros((len(rows), len(codes)), np.float32)
        m[np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.searchsorted(codes, np.concatenate(rows))] = 1
        return m

    return (table(of_a) @ table(of_b).T)[at_i, at_j] == 0


def _compared(kind: type, cosine: float):
    """(node, n, root): for every vector of a block pair that has a link in it, the
    copies it links to for the first time here, and the first vector of its local component."""

    def compare(table: pa.Table) -> pa.Table:
        dim, leaf = table.column("dim")[0].as_py(), table.column("leaf")[0].as_py()
        side = table.column("left").to_numpy(zero_copy_only=False)
        node, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        x = unit_vectors(_matrix(table.column("vector").combine_chunks(), dim, kind))
        leaves = table.column("leaves").to_pylist()
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        a = np.flatnonzero(side)
        b = a if same else np.flatnonzero(~side)
        i, j = np.nonzero(x[a] @ x[b].T >= cosine)
        i, j = a[i], b[j]
        if same:
            i, j = i[i < j], j[i < j]
        new = _first_meeting(leaves, leaves, leaf, i, j)
        n = np.bincount(i[new], copies[j[new]], len(node)) + np.bincount(j[new], copies[i[new]], len(node))
        label = np.arange(len(node))
        while True:
            low = np.minimum(label[i], label[j])
            after = label.copy()
            np.minimum.at(after, i, low)
            np.minimum.at(after, j, low)
            after = after[after]
            if (after == label).all():
                break
            label = after
        linked = np.unique(np.concatenate([i, j]))
        return pa.table({"node": node[linked], "n": n[linked].astype(np.int64), "root": node[label[linked]]})

    return compare


def _usable(vector: str) -> str:
    return (
        f"{vector} IS NOT NULL AND exists({vector}, x -> x <> 0) AND "
        f"NOT exists({vector}, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    )


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, trees: int = TREES) -> DataFrame:
    """(id, n_links, component_id): one row per row of ``vectors``.

    Vectors that are null, empty or zero, or hold a null or a non-finite number,
    have no links and are components of their own; vectors of different lengths
    do not link. Copies of a vector link with each other. A null id takes part;
    a component without another id has a null ``component_id``. Different vectors are
    numbered; rows find theirs by 128 bits of hash.
    """
    kind = np.float64 if "double" in vectors.schema[vector_col].dataType.simpleString() else np.float32
    usable = F.coalesce(F.expr(_usable("vector")), F.lit(False))
    digest = F.when(usable, F.struct(F.xxhash64("vector").alias("h"), F.xxhash64(F.lit(1), "vector").alias("h2")))
    named = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector")).withColumn("digest", digest)
    # Numbered once: what is written is what every later use reads.
    folded = durable(
        named.where("digest IS NOT NULL").groupBy("digest.h", "digest.h2", "vector")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id")).withColumn("node", F.monotonically_increasing_id())
    )
    models = {}
    for row in folded.groupBy(F.size("vector").alias("dim")).count().collect():  # lengths of vectors: usually one
        chosen = folded.where(F.size("vector") == row["dim"]).orderBy(F.xxhash64(F.lit(7), "h")).limit(SAMPLE).select("vector").toArrow()
        models[row["dim"]] = fit(unit_vectors(np.stack(chosen.column(0).to_numpy())), row["count"], trees, cosine=cosine)

    routed = folded.select("node", "copies", "vector").mapInArrow(_routed(models, kind), _ROUTED)
    counted = routed.groupBy("dim", "leaf", "first").count()
    sums = counted.groupBy("dim", "leaf").agg(
        F.sum("count").alias("all"), F.collect_list(F.when((F.col("first") >= 0) & (F.col("count") > BLOCK), F.struct("first", "count"))).alias("clusters")
    )
    large = sums.where(F.col("all") > BLOCK).collect() if models else []
    # Leaves are at most TREES * SAMPLE / SAMPLE_IN_LEAF per length and their clusters hold over BLOCK vectors, so both tables below are bounded.
    sizes, clusters = [], []
    for r in large:
        start = -(-(r["all"] - sum(c["count"] for c in r["clusters"])) // BLOCK)
        rest = start
        for c in r["clusters"]:
            clusters.append((r["dim"], r["leaf"], c["first"], start, -(-c["count"] // BLOCK)))
            start += clusters[-1][-1]
        sizes.append((r["dim"], r["leaf"], rest, start))
    spark = vectors.sparkSession
    sizes = spark.createDataFrame(sizes, "dim int, leaf int, rest int, n int")
    clusters = spark.createDataFrame(clusters, "dim int, leaf int, first int, start int, g int")
    dealt = routed.join(F.broadcast(sizes), ["dim", "leaf"], "left").join(F.broadcast(clusters), ["dim", "leaf", "first"], "left")
    dealt = dealt.withColumn("n", F.coalesce("n", F.lit(1))).withColumn("hash", F.xxhash64("node"))
    dealt = dealt.withColumn("mine", F.expr("coalesce(start, 0) + pmod(hash, coalesce(g, rest, 1))").cast("int"))
    others = F.expr("filter(sequence(0, n - 1), o -> start IS NULL OR o < start OR o >= start + g)")  # a cluster was compared with itself in ``first``
    dealt = dealt.withColumn("other", F.explode(others)).select(
        "dim", "leaf", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
        (F.col("mine") <= F.col("other")).alias("left"), "node", "copies", "vector", "leaves",
    )
    found = durable(dealt.groupBy("dim", "leaf", "i", "j").applyInArrow(_compared(kind, cosine), "node bigint, n bigint, root bigint"))
    counts = found.groupBy("node").agg(F.sum("n").alias("n")).select(F.col("node").alias("counted"), "n")
    ids = smallest_ids(folded.select("node", "first_id"), found.where("node <> root").select("node", "root"))
    facts = durable(
        ids.join(counts, F.col("node") == F.col("counted"), "left").join(folded.select(F.col("node").alias("folded"), "h", "h2", "copies"), F.col("node") == F.col("folded"))
        .select("h", "h2", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    on_node = named.select("id", "digest.h", "digest.h2").join(facts, ["h", "h2"], "left")
    return on_node.select(
        "id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.when(F.col("h").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
    )
