"""Quality by compression: a text is good when a dictionary of good text saves
more bytes on it than one of bad text.

Two zstandard dictionaries are trained, one from good and one from bad labelled
texts. A text is cut into blocks of ``BLOCK`` bytes, all of them compressed with
either dictionary; with B and G the summed sizes, the difference normalised by the size
of the text, (B - G) / bytes, is its evidence. It is divided by the text and not by
B + G since a text that repeats itself is small either way: it owes nothing to the
good dictionary, which is evidence against it. A rising curve fitted on labelled
texts that the dictionaries have not seen turns the evidence into a probability.
Blocks keep the dictionary in play over a long text, which else would soon only
refer to itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .training import fit_logistic, fit_monotone, held_out, labelled_sample, sigmoid

#: Bounds of the training sample: texts of each label, and characters of one text.
PER_CLASS = 2500
MAX_CHARS = 20_000
DICTIONARY_BYTES = 112_640
BLOCK = 2048
LEVEL = 3
THRESHOLD = 0.3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    intercept: float
    knots: tuple[tuple[float, ...], tuple[float, ...]] = ((), ())

    def probability(self, x: np.ndarray) -> np.ndarray:
        """The monotone curve, with a fiftieth of the logistic one so that no two
        amounts of evidence score the same."""
        logistic = sigmoid(self.slope * x + self.intercept)
        return 0.98 * np.interp(x, *self.knots) + 0.02 * logistic if len(self.knots[0]) else logistic


def _blocks(text: str | None) -> list[bytes]:
    raw = (text or "").encode()
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


class _Sizes:
    """Compressed sizes of a text with both dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        self._each = [
            zstandard.ZstdCompressor(
                dict_data=zstandard.ZstdCompressionDict(d), level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
            for d in (good, bad)
        ]

    def difference(self, text: str | None) -> float:
        blocks = _blocks(text)
        if not blocks:
            return 0.0
        good, bad = (sum(len(c.compress(b)) for b in blocks) for c in self._each)
        return (bad - good) / sum(map(len, blocks))


#: With less text than this of either label nothing is trained: the texts are the dictionaries.
ENOUGH_BYTES = 4 * DICTIONARY_BYTES


def _dictionaries(good: list[str], bad: list[str]) -> tuple[bytes, bytes]:
    """A dictionary of each. From little text a trained one would be much smaller for the
    rarer label; then both are plain text of one size, an equal share of every block."""
    samples = [[b for t in texts for b in _blocks(t)] for texts in (good, bad)]
    sizes = [sum(map(len, blocks)) for blocks in samples]
    if min(sizes) >= ENOUGH_BYTES:
        try:
            trained = [zstandard.train_dictionary(min(DICTIONARY_BYTES, n // 8), blocks).as_bytes() for n, blocks in zip(sizes, samples)]
            return trained[0], trained[1]
        except zstandard.ZstdError:  # text that repeats too little or too much
            pass
    most = min(DICTIONARY_BYTES, *sizes)
    plain = [b"".join(x[: max(1, -(-len(x) * most // n))] for x in blocks)[:most] if n else b"" for n, blocks in zip(sizes, samples)]
    return plain[0], plain[1]


#: Parts that the sample is cut into for the calibration.
PARTS = 5


def fit(sample: DataFrame) -> QualityModel:
    """A model from ``labelled_sample`` rows, which it collects.

    The calibration is cross-fitted: each of ``PARTS`` parts is measured with the
    dictionaries of the others, so every text calibrates and every text trains the final
    dictionaries. Without two texts of either label the score is the share of label 1
    (0.5 for an empty sample)."""
    rows = sorted((r["doc_id"], r["text"] or "", r["label"]) for r in sample.collect())
    texts = {v: [t for _, t, y in rows if y == v] for v in (0, 1)}
    if min(map(len, texts.values())) < 2:
        share = (len(texts[1]) + 1) / (len(rows) + 2)
        return QualityModel(b"", b"", 0.0, float(np.log(share / (1 - share))))
    parts, x, y = min(PARTS, *map(len, texts.values())), [], []
    for part in range(parts):
        sizes = _Sizes(*_dictionaries(*([t for i, t in enumerate(texts[v]) if i % parts != part] for v in (1, 0))))
        for v in (0, 1):
            left = texts[v][part::parts]
            x += [sizes.difference(t) for t in left]
            y += [float(v)] * len(left)
    x, y = np.array(x), np.array(y)
    scale = x.std() or 1.0
    w = fit_logistic(x[:, None] / scale, y)
    good, bad = _dictionaries(texts[1], texts[0])
    return QualityModel(good, bad, float(w[0] / scale), float(w[1]), tuple(tuple(k.tolist()) for k in fit_monotone(x, y)))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the probability of label 1 of every whole text. Null and
    empty texts have no evidence and get the calibration's value at zero."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = _Sizes(model.good, model.bad) if model.good else None
        for batch in batches:
            x = np.array([sizes.difference(t.as_py()) if sizes else 0.0 for t in batch.column(1)], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.probability(x))], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(apply, "doc_id bigint, score double")


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of ``docs``. The model
    is fitted when the query is defined; scoring needs no shuffle. A null id is in
    no fold and is not held out."""
    model = fit(labelled_sample(docs, labels, "quality", per_class, max_chars))
    return score(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
