"""Toxicity by cumulative-link ordinal regression on sparse word features.

Severity has ordered grades 0 < 1 < ... < K - 1. One weight vector w over hashed
words is shared by all thresholds b_1 < ... < b_{K-1}:

    P(grade >= j) = sigmoid(w . x - b_j)

and the expected severity is the sum of these over j. x holds ln(1 + count) of
each lower-cased word and of each beginning of a word with ``STEMS`` characters
(stems take many endings). A feature has a weight only if its share of texts
differs between clean and toxic ones beyond chance (``SCREEN`` standard errors), so
that a long text does not gather the noise of thousands of rare words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .training import labelled_sample, sigmoid

#: Bounds of the training sample: texts of each label, and characters of one text.
PER_CLASS = 1500
MAX_CHARS = 20_000
#: With fewer learned texts of either label nothing is rejected.
MIN_LABELLED = 5
BUCKETS = 1 << 18
#: Lengths of word beginnings, and what a feature needs to get a weight.
STEMS = (4, 5, 6, 7, 8)
MIN_DOCS = 5
SCREEN = 4.0
#: A document is rejected from this expected severity on. On held-out labels it
#: catches a few more toxic texts than 0.5 (99 against 95 %) and hardly more clean ones.
REJECT_FROM = 0.3

_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray  # BUCKETS
    thresholds: np.ndarray  # K - 1, ascending

    def severity(self, x: float) -> float:
        return float(sigmoid(x - self.thresholds).sum())


@lru_cache(maxsize=50_000)
def buckets_of(word: str) -> tuple[int, ...]:
    """Feature numbers of a word: itself and its beginnings."""
    names = {"=" + word, *(word[:k] for k in STEMS if len(word) >= k)}
    return tuple(sorted({xxhash.xxh64_intdigest(n.encode()) % BUCKETS for n in names}))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a text, each bucket once."""
    merged: Counter = Counter()
    for word, n in Counter(_WORD.findall((text or "").lower())).items():
        for bucket in buckets_of(word):
            merged[bucket] += n
    return np.fromiter(merged, np.int32, len(merged)), np.log1p(np.fromiter(merged.values(), np.float32, len(merged)))


def _thresholds(free: np.ndarray) -> np.ndarray:
    """Ascending thresholds from free parameters: the first, then log distances."""
    return np.concatenate([free[:1], free[:1] + np.cumsum(np.exp(free[1:]))])


@dataclass(frozen=True)
class Texts:
    """Features of many texts as one sparse matrix: (row, bucket, value) entries."""

    rows: np.ndarray
    buckets: np.ndarray
    values: np.ndarray
    n: int

    @classmethod
    def of(cls, texts: Iterable[str | None]) -> Texts:
        found = [features(t) for t in texts]
        lengths = [len(b) for b, _ in found]
        return cls(
            np.repeat(np.arange(len(found), dtype=np.int32), lengths),
            np.concatenate([np.empty(0, np.int32), *(b for b, _ in found)]),
            np.concatenate([np.empty(0, np.float32), *(v for _, v in found)]), len(found),
        )

    def texts_with(self, chosen: np.ndarray) -> np.ndarray:
        """In how many of the chosen texts (a boolean each) each bucket occurs."""
        return np.bincount(self.buckets[chosen[self.rows]], minlength=BUCKETS)

    def only(self, kept: np.ndarray) -> Texts:
        """The entries of the kept buckets (a boolean each)."""
        at = kept[self.buckets]
        return Texts(self.rows[at], self.buckets[at], self.values[at], self.n)


def fit(texts: Texts, grades: np.ndarray, weight_of_grade: np.ndarray | None = None, rounds: int = 300, l2: float = 1e-4,
        rate: float = 0.2) -> ToxicityModel:
    """Minimises the mean negative log-likelihood of the grades (0, 1, ...) with
    Adam over the whole bounded sample. A sample with one grade only, or none,
    gives that grade to everything."""
    grades = np.asarray(grades, np.int64)
    top = int(grades.max(initial=0))
    if not len(grades) or len(np.unique(grades)) < 2:
        return ToxicityModel(np.zeros(BUCKETS), np.repeat(-60.0 if top else 60.0, max(top, 1)))
    toxic = grades > 0
    in_toxic, in_clean = texts.texts_with(toxic), texts.texts_with(~toxic)
    n_toxic, n_clean = toxic.sum(), (~toxic).sum()
    pooled = (in_toxic + in_clean) / len(grades)
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / n_toxic + 1 / max(n_clean, 1)))
    distinct = np.abs(in_toxic / n_toxic - in_clean / max(n_clean, 1)) >= SCREEN * error
    texts = texts.only((in_toxic + in_clean >= MIN_DOCS) & distinct)
    rows, values = texts.rows, texts.values
    used, column = np.unique(texts.buckets, return_inverse=True)
    share = np.ones(top + 1) if weight_of_grade is None else weight_of_grade[: top + 1]
    sample_weight = share[grades] / share[grades].sum()

    at_least = [(grades >= j).mean() for j in range(1, top + 1)]
    start = -np.log(np.clip(at_least, 1e-3, 1 - 1e-3) / (1 - np.clip(at_least, 1e-3, 1 - 1e-3)))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.1))])
    params = np.concatenate([np.zeros(len(used)), free])
    m, v = np.zeros_like(params), np.zeros_like(params)
    n = len(grades)
    for step in range(1, rounds + 1):
        w, free = params[: len(used)], params[len(used) :]
        b = np.concatenate([[-np.inf], _thresholds(free), [np.inf]])
        x = np.bincount(rows, weights=w[column] * values, minlength=n)
        with np.errstate(over="ignore"):
            above, below = sigmoid(np.clip(x - b[grades], -60, 60)), sigmoid(np.clip(x - b[grades + 1], -60, 60))
        p = np.maximum(above - below, 1e-12)
        da, db = above * (1 - above), below * (1 - below)  # P(grade) = above - below
        dx = -(da - db) / p * sample_weight
        gw = np.bincount(column, weights=dx[rows] * values, minlength=len(used)) + l2 * w
        gb = np.zeros(top)
        np.add.at(gb, np.maximum(grades - 1, 0), np.where(grades > 0, da / p * sample_weight, 0))
        np.add.at(gb, np.minimum(grades, top - 1), np.where(grades < top, -db / p * sample_weight, 0))
        gf = np.concatenate([[gb.sum()], [gb[j:].sum() * np.exp(free[j]) for j in range(1, top)]])
        g = np.concatenate([gw, gf])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(BUCKETS)
    weights[used] = params[: len(used)]
    return ToxicityModel(weights, _thresholds(params[len(used) :]))


def grades_of(texts: Texts, toxic: np.ndarray) -> np.ndarray:
    """Severity grades from a yes/no label: 0 clean, 1 toxic, 2 toxic and dense.

    Typical of toxic texts are features found in a far larger share of them than of
    clean ones; a toxic text in which they occur more often than in the median
    toxic text has grade 2.
    """
    toxic = np.asarray(toxic, bool)
    if not toxic.any():
        return np.zeros(texts.n, np.int64)
    in_toxic, in_clean = texts.texts_with(toxic), texts.texts_with(~toxic)
    typical = texts.only((in_toxic >= MIN_DOCS) & (in_toxic / toxic.sum() > 5 * (in_clean + 1) / max(1, (~toxic).sum())))
    hits = np.bincount(typical.rows, np.expm1(typical.values), texts.n)
    return np.where(toxic, np.where(hits > np.median(hits[toxic]), 2, 1), 0)


def fit_on(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> ToxicityModel:
    """The model of the bounded sample of labelled documents, which is collected.
    The sample has as many texts of either label; the fit weighs them back to the
    shares that the labels have in ``labels``. With fewer than ``MIN_LABELLED`` texts of either
    label there is nothing to learn from: every severity is 0."""
    rows = sorted((r["doc_id"], r["text"] or "", r["label"]) for r in labelled_sample(docs, labels, "toxic", per_class, max_chars).collect())
    toxic = np.array([y for *_, y in rows], np.int64)
    if min(int(toxic.sum()), len(toxic) - int(toxic.sum())) < MIN_LABELLED:
        return ToxicityModel(np.zeros(BUCKETS), np.empty(0))
    texts = Texts.of(t for _, t, _ in rows)
    del rows
    buckets_of.cache_clear()
    of = {r["toxic"]: r["count"] for r in labels.where(F.col("toxic").isin(0, 1)).groupBy("toxic").count().collect()}
    share = np.array([of.get(y, 0) / max(1, (toxic == y).sum()) for y in (0, 1, 1)])
    return fit(texts, grades_of(texts, toxic), share)


def not_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` below ``REJECT_FROM``, with all their columns as they are."""
    out = "severity"
    while out in {c.lower() for c in docs.columns}:
        out += "_"
    return severity(docs, model, out=out).where(F.col(out) < REJECT_FROM).select(*docs.columns)


def severity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "severity") -> DataFrame:
    """``docs`` with a column ``severity`` (or ``out``): the expected grade of the whole text,
    null and empty texts included (their value at no words). All other columns pass
    through; a column of that name in the input is replaced."""
    used = np.flatnonzero(model.weights)
    weights = dict(zip(used.tolist(), model.weights[used].tolist()))
    kept = [c for c in docs.columns if c.lower() != out]
    schema = docs.select(*kept).withColumn(out, F.lit(0.0)).schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}  # word: its buckets with a weight

        def weighted(word: str) -> tuple[int, ...]:
            found = cache.get(word)
            if found is None:
                if len(cache) > 500_000:  # bounds the worker's memory, not the words
                    cache.clear()
                found = cache[word] = tuple(b for b in buckets_of(word) if b in weights)
            return found

        def evidence(text: str | None) -> float:
            counts: Counter = Counter()
            for word, n in Counter(_WORD.findall((text or "").lower())).items():
                for bucket in weighted(word):
                    counts[bucket] += n
            return sum(weights[b] * float(np.log1p(n)) for b, n in sorted(counts.items()))

        at = kept.index(text_col)
        for batch in batches:
            values = [model.severity(evidence(t.as_py())) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*kept, out])

    return docs.select(*kept).mapInArrow(apply, schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, severity, toxic) for every row of ``docs``; ``toxic`` from an
    expected severity of ``REJECT_FROM`` on."""
    model = fit_on(docs, labels)
    return severity(docs.select("doc_id", "text"), model).select("doc_id", "severity", (F.col("severity") >= REJECT_FROM).alias("toxic"))
