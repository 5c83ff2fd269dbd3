"""Percentiles of a column too large for one task. NaN is no value here: it is
left out like NULL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Accuracy of the sketch that brackets a rank: off by one row in so many at most.
ACCURACY = 20_000


def usable(column: str) -> Column:
    """The column as a double; NULL for NaN."""
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


#: Rows by which a plain sketch may miss a rank: one in so many.
APPROXIMATE = 10_000


def sketch(v: Column, quantiles: list[float]) -> Column:
    """The values at ranks just below each quantile, then just above each."""
    around = [max(0.0, q - 2 / ACCURACY) for q in quantiles] + [min(1.0, q + 2 / ACCURACY) for q in quantiles]
    return F.percentile_approx(v, around, ACCURACY)


def bracket_of(q: float, total: Column, least: Column, most: Column, cuts: Column, i: int, n: int) -> tuple[Column, Column, Column]:
    """(quantile, low, high): values between which the i-th of n quantiles lies. A group of up to
    ``ACCURACY`` values is its own bracket."""
    whole = total <= ACCURACY
    low = F.when(whole | F.lit(q - 2 / ACCURACY <= 0.0), least).otherwise(F.get(cuts, F.lit(i)))
    high = F.when(whole | F.lit(q + 2 / ACCURACY >= 1.0), most).otherwise(F.get(cuts, F.lit(n + i)))
    return F.lit(q).alias("quantile"), low.alias("low"), high.alias("high")


def interpolated(folded: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, value) from (keys, v, n), ``keys`` with ``quantile`` and ``total``: values of a
    bracket with their counts, and under a NULL v the number of values below it."""
    before = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = folded.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    position = F.col("quantile") * (F.col("total") - 1)

    def value_at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("start")) & (rank < F.col("start") + F.col("n")), F.col("v")))

    lower, upper = value_at(F.floor(position)), value_at(F.ceil(position))
    fraction = F.max(position - F.floor(position))
    return ranked.groupBy(*keys).agg((lower + (upper - lower) * fraction).alias("value"))


def exact_percentiles(df: DataFrame, column: str, quantiles: Iterable[float], by: str | None = None) -> DataFrame:
    """([by,] quantile, value), interpolated between neighbours. ``by`` splits
    the rows into a few groups, such as two snapshots.

    The built-in exact percentile keeps every distinct value of the group in
    one task. Here a first pass brackets each wanted rank by a sketch of known
    error; a second pass counts the values below the bracket and keeps, folded to
    (value, count), only those inside it: about four rows in ``ACCURACY``. Both are
    plain aggregations that combine before the shuffle, nothing is written, and
    nothing runs before an action.
    """
    quantiles = [float(q) for q in quantiles]
    group = F.lit(True) if by is None else F.col(by)
    values = df.select(group.alias("g"), usable(column).alias("v")).where("v IS NOT NULL")
    known = [F.col(c) for c in ("total", "least", "most", "cuts")]
    brackets = (
        values.groupBy("g").agg(sketch(F.col("v"), quantiles).alias("cuts"), F.count("v").alias("total"), F.min("v").alias("least"), F.max("v").alias("most"))
        .select("g", "total", F.array(*(F.struct(*bracket_of(q, *known, i, len(quantiles))) for i, q in enumerate(quantiles))).alias("brackets"))
    )
    # one row per group; a group is a snapshot
    near = values.join(F.broadcast(brackets), "g").select("g", "total", "v", F.inline("brackets")).where("v <= high")
    keys = ["g", "quantile", "total"]
    folded = near.groupBy(*keys, F.when(F.col("v") >= F.col("low"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return interpolated(folded, keys).select(*([] if by is None else [F.col("g").alias(by)]), "quantile", "value")


def approx_percentiles(df: DataFrame, column: str, quantiles: Iterable[float], by: str | None = None,
                       accuracy: int = APPROXIMATE) -> DataFrame:
    """([by,] quantile, value) from one pass with a bounded sketch per task and
    group; the rank of a value is off by one row in ``accuracy`` at most."""
    quantiles = [float(q) for q in quantiles]
    keys = [] if by is None else [by]
    found = df.groupBy(*keys).agg(F.percentile_approx(usable(column), quantiles, accuracy).alias("found"))
    pairs = F.arrays_zip(F.array(*map(F.lit, quantiles)).alias("quantile"), F.col("found").alias("value"))
    return found.select(*keys, F.inline(pairs).alias("quantile", "value"))
