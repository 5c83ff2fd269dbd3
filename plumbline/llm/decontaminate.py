"""Benchmark decontamination by winnowing, in DataFrame functions only.

A *window* is ``SPAN`` (10) consecutive words of a benchmark item; an item with
fewer words is one window by itself. A word of a document is hit when it lies in
an occurrence of a window.

The hashes of all ``GRAM`` (4) consecutive words are taken and of every
``SPAN - GRAM + 1`` (7) of them the smallest is kept: the fingerprint of the
window of 10 words they come from. Equal windows have equal fingerprints whatever
surrounds them, so every shared span of 10 words or more shares one. Consecutive
windows with the same fingerprint are one row of the join. Matches are extended
by comparing the words themselves, so a hash collision costs time only.

Words are hashed in lower case of the whole alphabet, which is coarser than the
A-Z wanted and much cheaper over a whole corpus; the comparison of the words is
exact. Items shorter than a window have no fingerprint and are looked up by their
first word.

Arrays are exploded with the outer form: for the plain form the optimizer derives a
filter on the array's size and pushes it down to the scan, where it would compute
the whole chain of arrays again for every element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import durable

SPAN = 10
GRAM = 4
#: Words as they are before A-Z are lowered: all but the ASCII characters that are no digit or
#: letter. They are listed one by one, since the regex engine looks single characters up in a
#: table and tries ranges in turn.
RAW_WORD = "[^" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A window table of up to so many bytes of text is broadcast, a larger one is joined by shuffle.
BROADCAST_BYTES = 8_000_000


def _known(id_col: str) -> Column:
    """An id as a text that is never null, so that joins keep rows without one."""
    return F.when(F.col(id_col).isNull(), "null").otherwise(F.concat(F.lit("="), F.col(id_col).cast("string")))


def _each(count: str, body: str) -> Column:
    """``body`` for i from 1 to ``count``; an empty array when there are none."""
    return F.expr(f"transform(IF({count} >= 1, sequence(1, {count}), array()), i -> {body})")


def _words(df: DataFrame, text: str) -> DataFrame:
    """``text`` replaced by ``words`` and ``hashes``, one per word."""
    split = df.withColumn("words", F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(RAW_WORD), 0)).drop(text)
    return split.withColumn("hashes", F.expr("transform(words, w -> xxhash64(lower(w)))"))


def _fingerprints(df: DataFrame) -> DataFrame:
    """Adds ``prints``: the fingerprint of every window of ``SPAN`` words."""
    grams = df.withColumn("grams", _each(f"(size(hashes) - {GRAM - 1})", f"xxhash64(slice(hashes, i, {GRAM}))"))
    width = SPAN - GRAM + 1
    return grams.withColumn("prints", _each(f"(size(grams) - {width - 1})", f"array_min(slice(grams, i, {width}))")).drop("grams")


def _plain(first: str, n: str) -> str:
    return f"translate(array_join(slice(words, {first}, {n}), ' '), '{_UPPER}', '{_LOWER}')"


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, words_in, key, window): the windows of every item, ``key`` being the
    fingerprint or, for a short item, the hash of its first word."""
    named = _words(items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")), "text")
    long = _fingerprints(named.where(F.size("words") >= SPAN))
    wide = long.select("item", "words", F.posexplode_outer("prints").alias("p", "key")).where("key IS NOT NULL").select(
        "item", F.lit(SPAN).alias("words_in"), "key", F.expr(_plain("p + 1", str(SPAN))).alias("window")
    )
    short = named.where(F.size("words").between(1, SPAN - 1)).select(
        "item", F.size("words").alias("words_in"), F.col("hashes")[0].alias("key"), F.expr(_plain("1", "size(words)")).alias("window")
    )
    return wide.unionByName(short).distinct()


def _runs(docs: DataFrame) -> DataFrame:
    """(…, key, a, b): runs a..b of windows (from 1) with the same fingerprint."""
    starts = F.expr("filter(IF(size(prints) >= 1, sequence(1, size(prints)), array()), i -> i = 1 OR get(prints, i - 1) <> get(prints, i - 2))")
    kept = [c for c in docs.columns if c not in ("hashes",)]
    found = _fingerprints(docs).withColumn("starts", starts)
    return found.select(*kept, "prints", "starts", F.posexplode_outer("starts").alias("p", "a")).select(
        *kept, F.expr("get(prints, a - 1)").alias("key"), "a", F.expr("coalesce(get(starts, p + 1) - 1, size(prints))").alias("b")
    )


def _first_words(docs: DataFrame) -> DataFrame:
    kept = [c for c in docs.columns if c not in ("hashes",)]
    return docs.select(*kept, F.posexplode_outer("hashes").alias("p", "key")).select(*kept, "key", (F.col("p") + 1).alias("a"), (F.col("p") + 1).alias("b"))


_EXTENDED = (
    "filter(sequence(a, b), s -> s + words_in - 1 <= size(words) AND "
    + _plain("s", "words_in") + " = window)"
)


def window_hits(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc, t, window, s, e): occurrences [s, e) of windows, in words from 1.

    ``docs`` has (doc, t, text), doc and t without nulls, ``windows`` what ``benchmark_windows`` gives.
    """
    table = windows.select("words_in", "key", "window").distinct()
    sizes = {
        row["short"]: row["bytes"]
        for row in table.groupBy((F.col("words_in") < SPAN).alias("short")).agg(F.sum(F.octet_length("window") + 32).alias("bytes")).collect()
    }
    cut = _words(docs, "text")
    found = []
    for short, named in ((False, _runs), (True, _first_words)):
        if short not in sizes:
            continue
        side = table.where((F.col("words_in") < SPAN) == F.lit(short))
        if sizes[short] <= BROADCAST_BYTES:  # measured just before
            # One pass: the words stay in the row, and are copied for matches only.
            matched = named(cut).join(F.broadcast(side), "key")
        else:
            # Only keys and places are shuffled; the words are read again for the documents that match.
            places = named(cut.select("doc", "t", "hashes")).join(side, "key").select("doc", "t", "a", "b", "words_in", "window")
            matched = places.join(cut.select("doc", "t", "words").distinct(), ["doc", "t"])
        extended = matched.select("doc", "t", "window", "words_in", F.explode_outer(F.expr(_EXTENDED)).alias("s")).where("s IS NOT NULL")
        found.append(extended.select("doc", "t", "window", "s", (F.col("s") + F.col("words_in")).alias("e")))
    if not found:
        return docs.select("doc", "t", F.lit("").alias("window"), F.lit(0).alias("s"), F.lit(0).alias("e")).where("false")
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


_COVERED = (
    "aggregate(sort_array(spans), struct(0 AS upto, 0L AS n), (acc, x) -> "
    "struct(greatest(acc.upto, x.e) AS upto, acc.n + greatest(0, x.e - greatest(acc.upto, x.s)) AS n), acc -> acc.n)"
)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated): one row per row of ``docs``.

    ``items`` are the ids of items with an occurring window, as strings in string
    order. Null and empty texts have no words; an empty benchmark hits nothing.
    Rows with a null or repeated id are judged each by its own text; items with a
    null id hit words but are not listed.
    """
    keyed = docs.select(
        F.col(id_col).alias("id"), _known(id_col).alias("doc"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("t"), F.col(text_col).alias("text")
    )
    own = ["doc", "t"]
    windows = benchmark_windows(items)
    hits = window_hits(keyed.drop("id"), windows)
    # Read twice below, and small: a row per contaminated text.
    hit = durable(
        hits.groupBy(own).agg(F.collect_set(F.struct("s", "e")).alias("spans"), F.collect_set("window").alias("windows"))
        .select(*own, F.expr(_COVERED).alias("n_hit"), "windows")
    )
    listed = (
        hit.select(*own, F.explode("windows").alias("window")).join(windows.select("window", "item"), "window")
        .groupBy(own).agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    n_words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(RAW_WORD)).cast("bigint")
    return (
        keyed.select("id", *own, n_words.alias("n_words")).join(hit.drop("windows"), own, "left").join(listed, own, "left")
        .select(F.col("id").alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
                F.coalesce("items", F.array().cast("array<string>")).alias("items"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
    )


def decontaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that have a word hit; all columns pass through. Null and
    empty texts, and rows with a null id and no hit, stay; rows are told apart by id and text."""
    own, name = F.xxhash64(F.col(id_col), F.col(text_col)), _known(id_col)
    hit = window_hits(docs.select(name.alias("doc"), own.alias("t"), F.col(text_col).alias("text")), benchmark_windows(items))
    whole = docs.select(F.struct(*docs.columns).alias("row"), name.alias("doc"), own.alias("t"))
    return whole.join(hit.select("doc", "t").distinct(), ["doc", "t"], "left_anti").select("row.*")
