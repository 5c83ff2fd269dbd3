"""Bounded samples of labelled documents for the classifiers, and a logistic fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Rows whose crc32(id as text) mod FOLDS is 0 are held out and never learned from.
FOLDS = 5


def held_out(id_col: str = "doc_id"):
    """True for a row of the held-out fold; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


#: A text over ``max_chars`` is learned from in so many pieces, spread evenly over it.
PIECES = 8


def spread(text: Column, max_chars: int) -> Column:
    """``text``, or ``PIECES`` pieces of it from start to end, ``max_chars`` in all, if it is longer."""
    size = max_chars // PIECES
    piece = F.transform(
        F.sequence(F.lit(0), F.lit(PIECES - 1)),
        lambda i: F.substring(text, (F.lit(1) + F.floor(i * (F.length(text) - size) / (PIECES - 1))).cast("int"), F.lit(size)),
    )
    return F.when(F.length(text) <= max_chars, text).otherwise(F.array_join(piece, " "))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int, seed: int = 42) -> DataFrame:
    """(doc_id, text, label): at most ``per_class`` texts of each value 0 and 1 of
    ``label``, those with the smallest hash of their id, from the learning folds.

    The chosen ids, at most ``2 * per_class``, are broadcast, so the documents are
    scanned once; only the chosen ones are shuffled. Of rows with one id that of the smallest text hash is taken, and of a
    text over ``max_chars`` characters pieces spread over it, which bounds the sample to
    ``2 * per_class`` rows of ``max_chars + PIECES``. Null texts, labels other than 0 and 1, and ids with
    two different labels are left out.
    """
    clean = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other")
    )
    order = (F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id"))
    chosen = [clean.where(F.col("label") == v).orderBy(*order).limit(per_class).select("doc_id", "label") for v in (0, 1)]
    found = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    one = found.select("doc_id", "label", F.struct(F.xxhash64("text").alias("h"), spread(F.col("text"), max_chars).alias("text")).alias("t"))
    return one.groupBy("doc_id", "label").agg(F.min("t").alias("t")).select("doc_id", "t.text", "label")


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights of ``x`` (n, d) and an intercept, by Newton steps on the mean loss."""
    design = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(design.shape[1])
    penalty = ridge * np.eye(len(w))
    for _ in range(rounds):
        p = sigmoid(design @ w)
        gradient = design.T @ (p - y) / len(y) + penalty @ w
        curvature = (design * (p * (1 - p))[:, None]).T @ design / len(y) + penalty
        step = np.linalg.solve(curvature, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit_monotone(x: np.ndarray, y: np.ndarray, prior: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Knots (x, probability) of a rising calibration curve: pool adjacent
    violators, then the mean position and the share of ones of each pool, drawn
    towards the share of all by ``prior`` observations."""
    order = np.argsort(x, kind="stable")
    share = float(y.mean())
    pools: list[list[float]] = []  # sum of x, sum of y, count
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        pools.append([a, b, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    at = np.array([p[0] / p[2] for p in pools])
    value = np.array([(p[1] + prior * share) / (p[2] + prior) for p in pools])
    return at, np.maximum.accumulate(value)
