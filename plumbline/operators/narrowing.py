"""Exact percentiles with a bound on what any task orders.

``quantiles.exact_percentiles`` is lazy and takes two passes, but orders a share of the rows
in one task, which grows with the table. Here the interval around each wanted rank is
narrowed by counts until few rows are left in it, however large the table is.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .quantiles import ACCURACY, usable

#: Rows left in the interval of a rank when they are put in order.
MOST = 100_000


@dataclass
class _Rank:
    """A wanted rank. Its value is ``value``, or lies between ``low`` and ``high``, both left
    out (None: unbounded), where ``inside`` values are; ``below`` values come before these."""

    group: object
    rank: int
    inside: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def holds(self) -> Column:
        v, inside = F.col("v"), F.col("g").eqNullSafe(F.lit(self.group))
        for bound, test in ((self.low, v > self.low if self.low is not None else None), (self.high, v < self.high if self.high is not None else None)):
            if bound is not None:
                inside = inside & test
        return inside

    def around(self) -> list[float]:
        share = (self.rank - self.below) / max(1, self.inside - 1)
        return [max(0.0, share - 2 / ACCURACY), min(1.0, share + 2 / ACCURACY)]

    def narrow(self, first: float, last: float, before: int, at_first: int, between: int, at_last: int) -> None:
        """Takes the part of the interval that has the rank, given how many values are before
        ``first``, equal to it, between the two and equal to ``last``."""
        place = self.rank - self.below
        upto_first, upto_last = before + at_first, before + at_first + between + at_last
        if place < before:
            self.high, self.inside = first, before
        elif place < upto_first:
            self.value = first
        elif place < upto_first + between:
            self.low, self.high, self.below, self.inside = first, last, self.below + upto_first, between
        elif place < upto_last:
            self.value = last
        else:
            self.low, self.below, self.inside = last, self.below + upto_last, self.inside - upto_last


def _narrowed(values: DataFrame, ranks: list[_Rank]) -> None:
    """One round: a sketch inside every interval, then exact counts around its two values. No
    row is moved: both passes are aggregations to one row."""
    cuts = values.agg(*(
        F.percentile_approx(F.when(r.holds(), F.col("v")), r.around(), ACCURACY).alias(f"c{i}") for i, r in enumerate(ranks)
    )).first()
    counts, v = [], F.col("v")
    for i, r in enumerate(ranks):
        first, last = cuts[f"c{i}"]
        parts = {"before": v < first, "first": v == first, "between": (v > first) & (v < last), "last": (v == last) & (v > first)}
        counts += [F.count_if(r.holds() & test).alias(f"{name}{i}") for name, test in parts.items()]
    found = values.agg(*counts).first()
    for i, r in enumerate(ranks):
        r.narrow(*cuts[f"c{i}"], *(found[f"{name}{i}"] for name in ("before", "first", "between", "last")))


def _ordered(values: DataFrame, ranks: list[_Rank]) -> None:
    """Puts the values left in each interval in order and takes the wanted ones."""
    which = F.array_compact(F.array(*(F.when(r.holds(), F.lit(i)) for i, r in enumerate(ranks))))
    folded = values.select("v", F.explode(which).alias("i")).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(before), F.lit(0))
    place = F.get(F.array(*(F.lit(r.rank - r.below).cast("bigint") for r in ranks)), F.col("i"))
    here = folded.select("i", "v", "n", start.alias("start"), place.alias("place")).where("place >= start AND place < start + n")
    for row in here.collect():  # a row per rank
        ranks[row["i"]].value = row["v"]


def percentiles_by_narrowing(df: DataFrame, column: str, quantiles: Iterable[float], by: str | None = None, most: int = MOST) -> DataFrame:
    """([by,] quantile, value), interpolated between neighbours; the answers of
    ``exact_percentiles``. NULL and NaN are no values; a group without any has no row.

    ``by`` splits the rows into a few groups, such as two snapshots. Runs when called: a round
    is two passes over the column and leaves about four rows in ``ACCURACY`` of each interval
    (and none that equal its bounds, so ties cannot hold it up); 10^12 rows take two rounds. At
    most ``most`` rows per wanted rank are then ordered. A few numbers per rank reach the driver.
    """
    quantiles = [float(q) for q in quantiles]
    group = F.lit(True) if by is None else F.col(by)
    values = df.select(group.alias("g"), usable(column).alias("v")).where("v IS NOT NULL")
    totals = [(r["g"], r["n"]) for r in values.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()]
    ranks = {(g, k): _Rank(g, k, n) for g, n in totals for q in quantiles for k in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))}
    while wide := [r for r in ranks.values() if r.value is None and r.inside > most]:
        _narrowed(values, wide)
    if left := [r for r in ranks.values() if r.value is None]:
        _ordered(values, left)
    rows = []
    for g, n in totals:
        for q in quantiles:
            at = q * (n - 1)
            low, high = (ranks[g, k].value for k in (math.floor(at), math.ceil(at)))
            rows.append((*(() if by is None else (g,)), q, low if low == high else low + (high - low) * (at - math.floor(at))))
    kinds = [] if by is None else [f"`{by}` {df.schema[by].dataType.simpleString()}"]
    return df.sparkSession.createDataFrame(rows, ", ".join([*kinds, "quantile double", "value double"]))
