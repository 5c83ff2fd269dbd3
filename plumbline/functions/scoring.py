"""Scoring formulas as column expressions, so millions of runs are graded by
one projection instead of one call per report."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import vocabulary as V
from .columns import ColumnLike, col, number_or_null


def count_accuracy(reported: ColumnLike, actual: ColumnLike, tolerance: float = V.COUNT_TOLERANCE,
                   monotone: bool = False) -> Column:
    """How close a reported count is to the truth, in [0, 1].

    The standard formula jumps up just past the tolerance; ``monotone=True``
    uses ``1 - ratio`` throughout instead.
    """
    r, a = col(reported).cast("double"), col(actual).cast("double")
    ratio = F.abs(r - a) / F.when(a != 0, a)
    outside = F.greatest(F.lit(0.0), 1.0 - ratio)
    inside = outside if monotone else F.greatest(F.lit(0.0), 1.0 - ratio / F.lit(tolerance))
    return (
        F.when(a == 0, F.when(r == 0, 1.0).otherwise(0.0))
        .when(ratio <= tolerance, inside)
        .otherwise(outside)
    )


def brier(base: Column, confidence: ColumnLike, correct: Column) -> Column:
    """Scale a score down by how far the stated confidence was from the outcome."""
    outcome = F.when(correct, 1.0).otherwise(0.0)
    miss = col(confidence).cast("double") - outcome
    return base * (1.0 - V.BRIER_PENALTY * miss * miss)


def strict(score: Column) -> Column:
    """Clamp into the open interval (0, 1); NULL and NaN become the low end."""
    low, high = F.lit(V.SCORE_EPSILON), F.lit(1.0 - V.SCORE_EPSILON)
    return (
        F.when(score.isNull() | F.isnan(score) | (score <= 0.0), low)
        .when(score >= 1.0, high)
        .otherwise(score)
    )


def weighted_sum(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    """Rounded to four places as a decimal: the noise of adding doubles cannot tip a tie."""
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + scores[name] * F.lit(weight)
    return F.round(total.cast("decimal(18,10)"), 4).cast("double")


def category_set(text: ColumnLike) -> Column:
    """``"a, b,,a"`` -> ``["a", "b"]``"""
    parts = F.transform(F.split(col(text), ","), lambda part: F.trim(part))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def set_f1(reported: Column, actual: Column) -> Column:
    """F1 of two sets given as arrays without repeats."""
    hits = F.size(F.array_intersect(reported, actual)).cast("double")
    precision = hits / F.greatest(F.size(reported), F.lit(1))
    recall = hits / F.greatest(F.size(actual), F.lit(1))
    return 2.0 * precision * recall / F.greatest(precision + recall, F.lit(1e-6))


def share_from_text(text: ColumnLike) -> Column:
    """``15%``, ``15`` and ``0.15`` all read 0.15; NULL when the first word is no number."""
    cleaned = F.trim(F.replace(col(text), F.lit("%"), F.lit(" ")))
    number = number_or_null(F.try_element_at(F.split(cleaned, r"\s+"), F.lit(1)))
    return F.when(number > 1, number / 100.0).otherwise(number)


def share_score(reported: ColumnLike, confidence: ColumnLike, actual: ColumnLike) -> Column:
    """Full credit within five points of the truth, half beyond, a fifth for an unreadable share."""
    close = F.abs(col(reported) - col(actual)) <= V.SHARE_TOLERANCE
    base = F.when(close, 1.0).otherwise(V.SHARE_MISS_CREDIT)
    return F.when(col(reported).isNull(), V.SHARE_UNREADABLE_CREDIT).otherwise(brier(base, confidence, close))


def mentions(text: ColumnLike, *words: str) -> Column:
    """Any of the words occurs in the text, whatever the case."""
    lowered = F.lower(F.coalesce(col(text), F.lit("")))
    found = F.lit(False)
    for word in words:
        found = found | lowered.contains(word)
    return found
