"""Substring dedup with prefix-partitioned suffix trees.

A *window* is ``length`` (50) consecutive words of one document. A word goes when
a window that covers it also starts in a document with a smaller id.

1. **Candidates.** Every window is named by its smallest hash of ``ANCHOR`` (8)
   consecutive words; consecutive windows of a document with the same name form
   one run. Equal windows have equal names whatever surrounds them, so a name
   that occurs in one document only rules its windows out. When all runs of a
   name have the same words, the document with the smallest id settles them.
2. **Trees.** The words of the runs left over (same name, different surroundings:
   edges of copies and passages) are grouped by name, that is by the anchor
   prefix which their suffixes share, several names to a group of bounded size.
   Each group builds the suffix tree of its runs: the leaves in order, and between
   neighbours the number of words they share, which gives the internal nodes. An
   internal node of depth 50 or more whose leaves are preceded by different words
   is a maximal repeat. A leaf below it is cut to the depth of the lowest node it
   shares with a document of a smaller id.
3. **Longer prefixes.** A name with more than ``CROWD`` such runs or more than
   ``CROWD_WORDS`` words in them (a passage in a third of all documents, a line that
   long documents repeat) would not fit a group. Its prefix is lengthened to the
   whole window: the suffixes are dealt by a 128-bit digest of their 50 words and
   only the smallest id of each is kept, combined before the shuffle.

Nothing is capped: each step settles whole windows, and the trees compare words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import durable
from .words import Words, runs_of_equal, sliding_minimum

LENGTH = 50
ANCHOR = 8
#: More runs than this under one name are dealt by the whole window.
CROWD = 2048
#: Or more words than this in its runs: in periodic text one run is a whole document.
CROWD_WORDS = 1_000_000
#: Words of runs that one group of trees should hold, on average.
GROUP_WORDS = 400_000
_LAST = np.iinfo(np.int64).max  # stands for a null id: later than any other


def _rows(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[c]) for c in kinds], list(kinds))


def _window_runs(words: Words, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first window, number of windows) of every run."""
    names = sliding_minimum(words.run_hashes(ANCHOR), length - ANCHOR + 1) if words.n >= length else np.empty(0, np.uint64)
    first, count = runs_of_equal(names)
    return names[first].view(np.int64), first, count


def window_runs(docs: DataFrame, length: int) -> DataFrame:
    """(name, doc, t, digest, first, count): the runs of every document. ``digest``
    is of the run's words; ``first`` and ``count`` are its windows."""
    kinds = {"name": pa.int64(), "doc": pa.int64(), "t": pa.int64(), "digest": pa.int64(), "first": pa.int32(), "count": pa.int32()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, name, digest, firsts, counts = [], [], [], [], []
            for i, text in enumerate(batch.column(2)):
                words = Words(text.as_py())
                names, first, count = _window_runs(words, length)
                at.append(np.full(len(first), i))
                name.append(names)
                firsts.append(first)
                counts.append(count)
                digest += [
                    xxhash.xxh3_64_intdigest(words.slice(a, a + c + length - 1))
                    for a, c in zip(first.tolist(), count.tolist())
                ]
            at, name, firsts, counts = (np.concatenate([np.empty(0, np.int64), *x]) for x in (at, name, firsts, counts))
            doc, t = (batch.column(c).to_numpy()[at] for c in (0, 1))
            cells = [name, doc, t, np.array(digest, np.uint64).view(np.int64), firsts, counts]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds.values())], list(kinds))

    return docs.select("doc", "t", "text").mapInArrow(cut, "name bigint, doc bigint, t bigint, digest bigint, first int, count int")


class Tree:
    """The suffix tree of runs of words, as its leaves in order and the depths between.

    ``leaves``: where each suffix starts in ``words``, in which every run ends with
    a mark of its own, so no two suffixes are equal. ``depths[i]``: how many words
    leaves i and i + 1 share, the depth of the internal node that parts them; only
    depths of ``length`` or more are worked out, others may be anything smaller.

    Suffixes are sorted by their first 1, 2, 4, ... words; only those that still share
    a place are sorted again. The places of every step are kept: read from the longest
    step to the shortest, they give the shared words of two suffixes.
    """

    def __init__(self, runs: list[bytes], length: int):
        ids: dict[bytes, int] = {}
        split = [r.split() for r in runs]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        codes = np.fromiter((ids.setdefault(w, len(ids)) for ws in split for w in ws), np.int64, int(sizes.sum()))
        self.run = np.repeat(np.arange(len(split)), sizes + 1)
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.words = np.empty(len(self.run), np.int64)
        self.words[np.arange(len(codes)) + np.repeat(np.arange(len(split)), sizes)] = codes
        self.words[self.starts + sizes] = len(ids) + np.arange(len(split))
        steps = self._places()
        self.leaves = np.empty(len(self.words), np.int64)
        self.leaves[steps[-1]] = np.arange(len(self.words))
        self.depths = self._shared(steps, length)

    def _places(self) -> list[np.ndarray]:
        """For 1, 2, 4, ... words: the place of every suffix, equal ones having the first of theirs."""
        n = len(self.words)
        counts = np.bincount(self.words)
        place = (np.cumsum(counts) - counts)[self.words].astype(np.int32)
        steps, depth = [place], 1
        while True:
            tied = np.flatnonzero(np.bincount(place, minlength=n)[place] > 1)
            if not len(tied):
                return steps
            key = place[tied].astype(np.int64) * n + place[tied + depth]
            order = np.argsort(key, kind="stable")
            key = key[order]
            old, index = key // n, np.arange(len(key))
            differs, leaves_old = (np.concatenate(([True], x[1:] != x[:-1])) for x in (key, old))
            inside = np.maximum.accumulate(np.where(differs, index, 0)) - np.maximum.accumulate(np.where(leaves_old, index, 0))
            place = place.copy()
            place[tied[order]] = old + inside
            steps.append(place)
            depth *= 2

    def _shared(self, steps: list[np.ndarray], length: int) -> np.ndarray:
        a, b = self.leaves[:-1], self.leaves[1:]
        depths = np.zeros(len(a), np.int64)
        near = min(int(length).bit_length(), len(steps)) - 1  # the longest step of at most ``length`` words
        pair = np.flatnonzero(steps[near][a] == steps[near][b])
        a, b, d = a[pair], b[pair], np.zeros(len(pair), np.int64)
        for k in range(len(steps) - 1, -1, -1):
            d += (steps[k][a + d] == steps[k][b + d]).astype(np.int64) << k
        depths[pair] = d
        return depths

    def maximal_repeats(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(at, depth): the leaves under internal nodes of depth ``length`` or more which
        are maximal repeats, node after node, and the depth between each and the next
        (0 after the last of a node).

        If all leaves under a node follow the same word, the node one word earlier has
        the same leaves and covers more, so it is left out.
        """
        deep, n = runs_of_equal(self.depths >= length)
        keep = self.depths[deep] >= length if len(deep) else np.empty(0, bool)
        deep, n = deep[keep], n[keep]
        before = np.where(self.leaves > 0, self.words[self.leaves - 1], -1)
        differing = np.concatenate(([0], np.cumsum(before[1:] != before[:-1])))
        keep = differing[deep + n] > differing[deep]
        deep, n = deep[keep], n[keep]
        leaf = np.arange(int((n + 1).sum())) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1) + np.repeat(deep, n + 1)
        depth = np.append(self.depths, 0)[leaf]
        depth[np.cumsum(n + 1) - 1] = 0
        return self.leaves[leaf], depth


def depth_with_earlier(doc: list[int], depth: list[int]) -> np.ndarray:
    """For every leaf the depth of the lowest node it shares with a smaller id: the
    nearest such leaf on either side decides. ``depth[i]`` is between i and i + 1."""
    best = np.zeros(len(doc), np.int64)
    for docs, depths, out in ((doc, depth, best), (doc[::-1], depth[-2::-1], best[::-1])):
        rising: list[tuple[int, int]] = []  # ids that rise, each with its depth with the one below
        for i, own in enumerate(docs):
            d = depths[i - 1] if i else 0
            while rising and rising[-1][0] >= own:
                d = min(d, rising.pop()[1])
            if rising and d > out[i]:
                out[i] = d
            rising.append((own, d))
    return best


_SPAN_SQL = "doc bigint, t bigint, s int, e int"


def _repeats_in_group(length: int):
    def find(table):
        doc, t, first = (table.column(c).to_numpy() for c in ("doc", "t", "first"))
        tree = Tree([w.as_py() for w in table.column("words")], length)
        at, depth = tree.maximal_repeats(length)
        run = tree.run[at]
        depth = depth_with_earlier(doc[run].tolist(), depth.tolist())
        hit = np.flatnonzero(depth >= length)
        hit = hit[np.argsort(at[hit])]
        at, run, end = at[hit], run[hit], np.maximum.accumulate(at[hit] + depth[hit])
        # Spans that touch are one; no span leaves its run.
        s, n = runs_of_equal(np.cumsum(np.concatenate(([True], at[1:] > end[:-1])))) if len(at) else (at, at)
        r, shift = run[s], first[run[s]] - tree.starts[run[s]]
        return pa.table({"doc": doc[r], "t": t[r], "s": (at[s] + shift).astype(np.int32), "e": (end[s + n - 1] + shift).astype(np.int32)})

    return find


def _run_words(length: int):
    """The words of each listed run, read from the document's text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"name": pa.int64(), "crowded": pa.bool_(), "doc": pa.int64(), "t": pa.int64(), "first": pa.int32(), "words": pa.binary()}
        for batch in batches:
            for row in batch.to_pylist():
                words = Words(row["text"])
                out = {c: [] for c in kinds}
                for r in row["runs"]:
                    out["name"].append(r["name"])
                    out["crowded"].append(r["crowded"])
                    out["doc"].append(row["doc"])
                    out["t"].append(row["t"])
                    out["first"].append(r["first"])
                    out["words"].append(words.slice(r["first"], r["first"] + r["count"] + length - 1))
                yield _rows(out, kinds)

    return read


def _suffix_digests(length: int):
    """(h1, h2, doc, t, at): a 128-bit digest of the words of every window."""
    kinds = {"h1": pa.int64(), "h2": pa.int64(), "doc": pa.int64(), "t": pa.int64(), "at": pa.int32()}
    low = (1 << 64) - 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = Words(row["words"].decode())
                n = words.n - length + 1
                sums = [xxhash.xxh3_128_intdigest(words.slice(i, i + length)) for i in range(n)]
                h = np.array([[x >> 64, x & low] for x in sums], np.uint64).reshape(-1, 2).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array([row["doc"]] * n, pa.int64()), pa.array([row["t"]] * n, pa.int64()),
                     pa.array(np.arange(n, dtype=np.int32) + row["first"])], list(kinds))

    return cut


def repeat_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, t, s, e): word spans [s, e) to remove; they may overlap.

    ``docs`` has (doc, t, text): the id with nulls as the largest long, and a hash
    of the text that tells rows with the same id apart.
    """
    runs = durable(window_runs(docs, length))
    names = (
        runs.groupBy("name")
        .agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc"), F.count(F.lit(1)).alias("n_runs"),
             F.min("digest").alias("d1"), F.max("digest").alias("d2"))
        .where("first_doc < last_doc")
        .select("name", "first_doc", "n_runs", (F.col("d1") == F.col("d2")).alias("alike"))
    )
    # The complement of the name is a key neither side is placed on yet: see components.py.
    names = names.select(F.bitwise_not("name").alias("k"), "first_doc", "n_runs", "alike")
    found = durable(
        runs.join(names, F.bitwise_not("name") == F.col("k")).where("NOT alike OR doc > first_doc")
        .select("name", "doc", "t", "first", "count", "n_runs", "alike")
    )
    settled = found.where("alike").select("doc", "t", F.col("first").alias("s"), (F.col("first") + F.col("count") + (length - 1)).alias("e"))

    unsettled = found.where("NOT alike")
    # A name in CROWD_WORDS words at least, so few names are broadcast.
    wordy = unsettled.groupBy("name").agg(F.sum(F.col("count") + (length - 1)).alias("n_words")).where(F.col("n_words") > CROWD_WORDS)
    crowded = (F.col("n_runs") > CROWD) | F.col("n_words").isNotNull()
    unsettled = unsettled.join(F.broadcast(wordy), "name", "left").withColumn("crowded", crowded)
    size = unsettled.agg(F.sum(F.col("count") + (length - 1)).alias("words"), F.max("crowded").alias("most")).first()
    if not size["words"]:
        return settled
    listed = unsettled.groupBy("doc", "t").agg(F.collect_list(F.struct("name", "crowded", "first", "count")).alias("runs"))
    words = durable(
        docs.select("doc", "t", "text").join(listed, ["doc", "t"]).select("doc", "t", "text", "runs")
        .mapInArrow(_run_words(length), "name bigint, crowded boolean, doc bigint, t bigint, first int, words binary")
    )
    groups = max(1, -(-size["words"] // GROUP_WORDS))
    by_tree = (
        words.where(~F.col("crowded")).withColumn("group", F.pmod(F.xxhash64("name"), F.lit(groups)))
        .groupBy("group").applyInArrow(_repeats_in_group(length), _SPAN_SQL)
    )
    spans = settled.unionByName(by_tree)
    if not size["most"]:
        return spans
    crowded = words.where("crowded")
    suffixes = crowded.mapInArrow(_suffix_digests(length), "h1 bigint, h2 bigint, doc bigint, t bigint, at int")
    earliest = suffixes.groupBy("h1", "h2").agg(F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc")).where("first_doc < last_doc")
    earliest = earliest.select(F.bitwise_not("h1").alias("k1"), F.bitwise_not("h2").alias("k2"), "first_doc")
    hits = suffixes.join(earliest, (F.bitwise_not("h1") == F.col("k1")) & (F.bitwise_not("h2") == F.col("k2"))).where("doc > first_doc")
    return spans.unionByName(hits.select("doc", "t", F.col("at").alias("s"), (F.col("at") + length).alias("e")))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, total, removed = [], [], []
        for text, spans in zip(batch.column(1), batch.column(2)):
            text, spans = text.as_py(), spans.as_py()
            words = (text or "").encode().split()
            n = len(words)
            if spans:
                keep = bytearray(b"\1") * n
                for x in spans:
                    keep[x["s"] : x["e"]] = bytes(x["e"] - x["s"])
                words = [w for w, k in zip(words, keep) if k]
            texts.append(b" ".join(words).decode())
            total.append(n)
            removed.append(n - len(words))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())],
            ["doc_id", "kept_text", "n_words", "n_removed"],
        )


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, kept_text, n_words, n_removed): one row per row of ``docs``.

    Kept words are joined by one space. A null or empty text has no words. A null
    id counts as later than any other. Rows with the same id are no repeats of each
    other; each is judged by itself. ``length`` must be at least ``ANCHOR``.
    """
    if length < ANCHOR:
        raise ValueError(f"length must be at least {ANCHOR}")
    keyed = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(int(_LAST))).alias("doc"), F.xxhash64(text_col).alias("t"),
        F.col(text_col).alias("text"), F.col(id_col).cast("bigint").alias("id"),
    )
    spans = repeat_spans(keyed, length).groupBy("doc", "t").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    return keyed.join(spans, ["doc", "t"], "left").select("id", "text", "spans").mapInArrow(
        _cut, "doc_id bigint, kept_text string, n_words bigint, n_removed bigint"
    )
