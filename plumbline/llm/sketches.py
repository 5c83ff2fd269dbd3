"""Ranked lexical search with hashed max-sketches.

The *impact* of a term in a document grows with its occurrences tf there: weight times
saturated tf. Weights belong to the query, so a document's sketch holds what is its
own: its terms are hashed to ``DIMENSIONS`` coordinates, and each coordinate has the
largest tf of the terms that fall on it. Only coordinates above zero are stored, in order, so
a sketch is a few bytes per distinct term.

A query looks its terms up in a whole batch of sketches at once. What a coordinate says
is never below the impact of the term, so the weighted sum is an upper bound of the score.
The documents with the highest bounds are rescored exactly, from their texts; the k-th of
these scores is a threshold that the true k-th score reaches too. Then all documents whose
bound reaches the threshold are rescored, the highest bounds first being done already.
No document above the threshold is left out, so the ranks are exact.

Rows of equal text have equal scores, and only the k smallest ids among them can be
ranked: batches and shuffles keep so many of each text, whatever the number of copies.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from ..session import durable, durable_table
from .bpe import steps

DIMENSIONS = 1 << 16
#: Rows a task bounds at a time, and distinct terms it counts before it hands them on.
STEP_ROWS = 2_000
TERMS_AT_ONCE = 200_000
#: Terms of the queries that are looked up in one pass over the sketches, about.
QUERY_TERMS = 200_000
#: Exactly rescored rows (a few numbers each) up to which they are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 100_000
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_IN_TERMS = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz" + _UPPER)
#: Bytes of terms lowered (A-Z only), all other ASCII made blank.
_FOLD = bytes((b | 32 if b in _UPPER else b) if b >= 128 or b in _IN_TERMS else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of all characters beyond ASCII, in
    order, with A-Z lowered."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


@functools.lru_cache(maxsize=200_000)
def coordinate(term: bytes) -> int:
    return xxhash.xxh64_intdigest(term, 13) % DIMENSIONS


def sketch(counts: Counter) -> tuple[list[int], list[int]]:
    """(coordinates in order, largest tf on each)."""
    most: dict[int, int] = {}
    for term, tf in counts.items():
        c = coordinate(term)
        if tf > most.get(c, 0):
            most[c] = tf
    at = sorted(most)
    return at, [most[c] for c in at]


@dataclass(frozen=True)
class Index:
    """``docs``: (doc_id, t, n, at, tf), a row per row of the corpus, t being a hash of the
    text; ``frequencies``: (term, df); both kept in the checkpoint folder. ``n_docs`` documents
    have a term, ``n_terms`` in all."""

    docs: DataFrame
    frequencies: DataFrame
    n_docs: int
    n_terms: int


def text_hash(text: str = "text"):
    """64 bits that, with the id, name a row's text."""
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Sketches and document frequencies of all rows, from one pass over the texts.

    Null and empty texts have no terms. Repeated rows and ids are rows like any other.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), text_hash(text_col).alias("t"), F.col(text_col).cast("string").alias("text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, df = None, Counter()

        def counted() -> pa.RecordBatch:
            columns = [pa.nulls(len(df), f.type) for f in list(schema)[:5]]
            columns += [pa.array(list(df), pa.binary()), pa.array(list(df.values()), pa.int64())]
            df.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            lists = pa.list_(pa.int32())
            schema = pa.schema([("doc_id", batch.schema.field("doc_id").type), ("t", pa.int64()), ("n", pa.int64()), ("at", lists), ("tf", lists),
                                ("term", pa.binary()), ("df", pa.int64())])
            lengths = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            for a, b in steps(lengths):
                part, k = batch.slice(a, b - a), b - a
                split = [terms(text) for text in part.column(2).to_pylist()]
                n, made = pa.array(list(map(len, split)), pa.int64()), []
                for words in split:
                    counts = Counter(words)
                    made.append(sketch(counts))
                    df.update(counts.keys())
                    if len(df) > TERMS_AT_ONCE:
                        yield counted()
                columns = [part.column(0), part.column(1), n, pa.array([x for x, _ in made], lists), pa.array([x for _, x in made], lists)]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64())], schema=schema)
        if df:
            yield counted()

    kind = source.dtypes[0][1]
    made = durable_table(source.mapInArrow(apply, f"doc_id {kind}, t bigint, n bigint, at array<int>, tf array<int>, term binary, df bigint"), "sketches")
    rows = made.where("term IS NULL").select("doc_id", "t", "n", "at", "tf")
    frequencies = made.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))
    total = rows.agg(F.sum((F.col("n") > 0).cast("bigint")).alias("docs"), F.sum("n").alias("terms")).first()
    return Index(rows, frequencies, total["docs"] or 0, total["terms"] or 0)


@dataclass(frozen=True)
class Block:
    """Some queries as columns: for each coordinate that one of their terms falls on, the
    (query, weight) that ask for it; ``weights``: {term: weight} of each query."""

    slot: np.ndarray
    first: np.ndarray
    query: np.ndarray
    weight: np.ndarray
    weights: list[dict[bytes, int]]

    @classmethod
    def of(cls, weights: list[dict[bytes, int]]) -> Block:
        asked = sorted((coordinate(t), q, w) for q, of in enumerate(weights) for t, w in of.items())
        at = np.array([c for c, _, _ in asked], np.int64)
        found, first = np.unique(at, return_index=True)
        slot = np.full(DIMENSIONS, -1, np.int64)
        slot[found] = np.arange(len(found))
        return cls(slot, np.append(first, len(at)), np.array([q for _, q, _ in asked], np.int64), np.array([w for _, _, w in asked], np.float64), weights)

    def bounds(self, at: np.ndarray, tf: np.ndarray, row: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """(documents, queries): the upper bounds of all scores. ``row`` is the document of
        each entry, ``norm`` its m. Whole numbers below 2^53, so the sums are exact."""
        slots = self.slot[at]
        hit = slots >= 0
        slots, row, tf = slots[hit], row[hit], tf[hit].astype(np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * norm[row])
        many = self.first[slots + 1] - self.first[slots]
        entry = np.repeat(self.first[slots] - np.cumsum(many) + many, many) + np.arange(many.sum())
        key = np.repeat(row, many) * len(self.weights) + self.query[entry]
        sums = np.bincount(key, np.repeat(impact, many) * self.weight[entry], len(norm) * len(self.weights))
        return sums.reshape(len(norm), len(self.weights))

    def score(self, query: int, counts: Counter, norm: int) -> int:
        return sum(w * (1_000_000_000 * tf // (1000 * tf + 8 * norm)) for t, w in self.weights[query].items() if (tf := counts.get(t)))


def _norm(n: int, n_docs: int, n_terms: int) -> int:
    return 10 + 90 * n * n_docs // n_terms


def _bounded(found: Index, block: Block, choose, schema: str) -> DataFrame:
    """What ``choose(keep)`` yields of the bounds of all documents; it gets an iterator of
    (ids, t, n, bounds) of a few documents at a time."""
    n_docs, n_terms = found.n_docs, found.n_terms
    rows_at_once = max(32, min(STEP_ROWS, 4_000_000 // max(1, len(block.weights))))

    def bounded(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for a in range(0, len(batch), rows_at_once):
                part = batch.slice(a, rows_at_once)
                n = part.column(2).to_numpy()
                norm = np.array([_norm(x, n_docs, n_terms) for x in n.tolist()], np.int64)
                at, tf = part.column(3), part.column(4)
                row = pc.list_parent_indices(at).to_numpy()
                bounds = block.bounds(at.flatten().to_numpy(), tf.flatten().to_numpy(), row, norm)
                yield np.array(part.column(0).to_pylist(), object), part.column(1).to_numpy(), n, bounds

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        kind = first.schema.field("doc_id").type
        for query, ids, t, n, bound in choose(bounded(_chain(first, batches))):
            yield pa.RecordBatch.from_arrays(
                [pa.array(query, pa.int32()), pa.array(ids.tolist(), kind), pa.array(t, pa.int64()), pa.array(n, pa.int64()), pa.array(bound.astype(np.int64))],
                ["query", "doc_id", "t", "n", "bound"],
            )

    return found.docs.mapInArrow(apply, schema)


def _chain(first, rest):
    yield first
    yield from rest


def _highest(k: int):
    """For each query the ``k`` highest bounds of a task."""

    def choose(parts):
        held = None
        for ids, t, n, bounds in parts:
            rows = len(ids)
            new = [np.broadcast_to(x[:, None], bounds.shape) for x in (ids, t, n)] + [bounds]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if len(held[3]) > k:
                top = np.argpartition(-held[3], k - 1, axis=0)[:k]
                held = [np.take_along_axis(x, top, 0) for x in held]
            elif rows:
                held = [np.array(x) for x in held]
        if held is not None:
            row, query = np.nonzero(held[3] > 0)
            yield query, *(x[row, query] for x in held)

    return choose


def _first_of_copies(ids: np.ndarray, t: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Which rows are among the ``k`` smallest ids of their text (null ids last)."""
    order = sorted(range(len(ids)), key=lambda i: (t[i], n[i], ids[i] is None, ids[i] if ids[i] is not None else 0))
    place, rank, last = np.zeros(len(ids), np.int64), 0, None
    for i in order:
        rank = rank + 1 if (t[i], n[i]) == last else 0
        last, place[i] = (t[i], n[i]), rank
    return np.flatnonzero(place < k)


def _reaching(threshold: np.ndarray, k: int):
    """All (document, query) whose bound reaches the query's threshold; of equal texts, the ``k`` smallest ids."""

    def choose(parts):
        for ids, t, n, bounds in parts:
            some = np.flatnonzero((bounds >= threshold).any(axis=1))
            some = some[_first_of_copies(ids[some], t[some], n[some], k)]
            row, query = np.nonzero(bounds[some] >= threshold)
            row = some[row]
            yield query, ids[row], t[row], n[row], bounds[row, query]

    return choose


def _rescored(docs: DataFrame, found: Index, block: Block, wanted: DataFrame) -> DataFrame:
    """(query, doc_id, t, score): the exact scores of ``wanted`` (query, doc_id, t), from the texts."""
    n_docs, n_terms = found.n_docs, found.n_terms
    asked = set().union(*block.weights)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, (text, queries) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                words = terms(text)
                counts, norm = Counter(w for w in words if w in asked), _norm(len(words), n_docs, n_terms)
                rows += [(k, q, block.score(q, counts, norm)) for q in queries]
            at = pa.array([k for k, _, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([q for _, q, _ in rows], pa.int32()), batch.column(0).take(at), batch.column(1).take(at), pa.array([s for *_, s in rows], pa.int64())],
                ["query", "doc_id", "t", "score"],
            )

    per_doc = durable(wanted.groupBy("doc_id", "t").agg(F.collect_set("query").alias("queries")).withColumnsRenamed({"doc_id": "i2", "t": "t2"}))
    side = F.broadcast(per_doc) if per_doc.count() <= BROADCAST_ROWS else per_doc
    texts = docs.join(side, F.col("doc_id").eqNullSafe(F.col("i2")) & (F.col("t") == F.col("t2"))).select("doc_id", "t", "text", "queries")
    kind = texts.dtypes[0][1]
    scored = texts.mapInArrow(apply, f"query int, doc_id {kind}, t bigint, score bigint")
    return scored.groupBy("query", "doc_id", "t").agg(F.max("score").alias("score"))  # repeated rows have one score


def _item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term): the distinct terms of each item."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = pa.array([sorted(set(terms(t))) for t in batch.column(1).to_pylist()], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pc.list_parent_indices(split)), split.flatten()], ["item_id", "term"])

    return items.mapInArrow(apply, f"item_id {items.dtypes[0][1]}, term binary").distinct()


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each item, all if fewer
    have a score above 0.

    A term's weight w is floor(1000 ln((2N + 2) / (2 df + 1))), a document's m is
    10 + 90 n N div L, and its score the sum of w (10^9 tf div (1000 tf + 8 m)). Equal
    scores are ranked by ascending id, null ids last; repeated rows take a rank each. Items
    without terms, or whose terms no document has, give no rows. Rows of one item id,
    also of the null one, are one item. Queries are answered in blocks of about ``QUERY_TERMS`` terms, each with two passes
    over the sketches; a block's terms, items and thresholds are all that reaches the driver.
    """
    spark = docs.sparkSession
    found = index(docs, id_col, text_col)
    source = docs.select(F.col(id_col).alias("doc_id"), text_hash(text_col).alias("t"), F.col(text_col).cast("string").alias("text"))
    named = items.select(F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2 * found.n_docs + 2).cast("double") / (2 * F.col("df") + 1)))
    weighted = durable(_item_terms(named).join(found.frequencies, "term").select("item_id", "term", weight.cast("bigint").alias("w")))
    n_blocks = -(-weighted.count() // QUERY_TERMS)
    kinds = source.dtypes[0][1], named.dtypes[0][1]
    empty = spark.createDataFrame([], f"item_id {kinds[1]}, rank int, doc_id {kinds[0]}, score bigint")
    ranked = empty
    for number in range(n_blocks):
        of_item: dict = {}
        for row in weighted.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == number).collect():
            of_item.setdefault(row["item_id"], {})[bytes(row["term"])] = row["w"]
        if not of_item:
            continue
        order = sorted(of_item, key=lambda x: (x is None, x if x is not None else 0))
        best = _search_block(source, found, Block.of([of_item[x] for x in order]), k)
        names = spark.createDataFrame(list(enumerate(order)), f"query int, item_id {kinds[1]}")
        ranked = ranked.unionByName(best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    return ranked


def _search_block(source: DataFrame, found: Index, block: Block, k: int) -> DataFrame:
    """(query, rank, doc_id, score) of a block of queries."""
    schema = f"query int, doc_id {source.dtypes[0][1]}, t bigint, n bigint, bound bigint"
    by_bound = Window.partitionBy("query").orderBy(F.desc("bound"), "doc_id", "t")
    tops = _bounded(found, block, _highest(k), schema)
    seeds = durable(tops.withColumn("place", F.row_number().over(by_bound)).where(F.col("place") <= k).select("query", "doc_id", "t"))
    first = durable(_rescored(source, found, block, seeds))
    # the k-th best exact score so far; one row per query
    of_seeds = seeds.groupBy("query", "doc_id", "t").agg(F.count(F.lit(1)).alias("times")).join(_renamed(first), _same_row()).select("query", "score", "times")
    threshold = np.ones(len(block.weights))
    kth = of_seeds.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "times")), asc=False).alias("s"))
    for row in kth.collect():
        scores = [x["score"] for x in row["s"] for _ in range(min(k, x["times"]))]
        if len(scores) >= k:
            threshold[row["query"]] = max(1, scores[k - 1])
    copies = Window.partitionBy("query", "t", "n", "bound").orderBy(F.asc_nulls_last("doc_id"))
    reaching = _bounded(found, block, _reaching(threshold, k), schema)
    wanted = durable(reaching.withColumn("place", F.row_number().over(copies)).where(F.col("place") <= k).select("query", "doc_id", "t"))
    rest = wanted.distinct().join(_renamed(first), _same_row(), "left_anti")
    scores = first.unionByName(_rescored(source, found, block, rest))
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "t")
    return (
        wanted.join(_renamed(scores), _same_row()).where("score > 0").withColumn("rank", F.row_number().over(by_score))
        .where(F.col("rank") <= k).select("query", "rank", "doc_id", "score")
    )


def _renamed(scores: DataFrame) -> DataFrame:
    return scores.withColumnsRenamed({"query": "q2", "doc_id": "i2", "t": "t2"})


def _same_row():
    return (F.col("query") == F.col("q2")) & F.col("doc_id").eqNullSafe(F.col("i2")) & (F.col("t") == F.col("t2"))
