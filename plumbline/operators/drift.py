"""Two snapshots of the same table side by side.

Snapshots are tagged and unioned where both are summarised, so a comparison is
one aggregation instead of two joined ones.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import share
from .quantiles import approx_percentiles, exact_percentiles, usable


def tagged(base: DataFrame, current: DataFrame, *columns: str) -> DataFrame:
    return base.select(F.lit(False).alias("is_current"), *columns).unionByName(
        current.select(F.lit(True).alias("is_current"), *columns)
    )


def of_baseline(c: str) -> Column:
    return F.when(~F.col("is_current"), F.col(c))


def of_current(c: str) -> Column:
    return F.when(F.col("is_current"), F.col(c))


def mean_shift(base: DataFrame, current: DataFrame, column: str) -> DataFrame:
    means = tagged(base, current, column).agg(
        F.avg(of_baseline(column)).alias("baseline_mean"),
        F.avg(of_current(column)).alias("current_mean"),
    )
    return means.withColumn("delta", F.col("current_mean") - F.col("baseline_mean"))


def new_categories(base: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """(category, n_rows) for values that only the current snapshot has; NULL is
    no category. Both sides are reduced to distinct values before they meet, and
    the join strategy is left to their measured size."""
    counts = current.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.join(base.select(column).distinct(), column, "left_anti")


def share_above(df: DataFrame, column: str, threshold, name: str = "share_above") -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg(F.when(n > 0, share(F.count_if(F.col(column) >= threshold), n)).alias(name))


def novel_reference_share(base: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Share of current rows whose key the baseline never had. A NULL key counts
    as never seen. Rows are folded per key before the join, so a hot key joins
    as one row."""
    counts = current.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    seen = base.select(key).distinct().withColumn("seen", F.lit(True))
    n_novel = F.coalesce(F.sum(F.when(F.col("seen").isNull(), F.col("n"))), F.lit(0))
    n_rows = F.coalesce(F.sum("n"), F.lit(0))
    return counts.join(seen, key, "left").agg(
        n_novel.alias("n_novel"), n_rows.alias("n_rows"),
        F.when(n_rows > 0, share(n_novel, n_rows)).alias("new_row_share"),
    )


def distribution_shift(base: DataFrame, current: DataFrame, column: str, quantiles: Iterable[float] = (0.25, 0.5, 0.75),
                       exact: bool = True) -> DataFrame:
    """(statistic, baseline_value, current_value, delta): standard deviation,
    percentiles and ``ignored``, the rows left out of both for being NULL or NaN."""
    find = exact_percentiles if exact else approx_percentiles
    both = tagged(base, current, column).select("is_current", usable(column).alias(column))
    spread = both.agg(
        F.array(
            F.struct(F.lit("stddev").alias("statistic"), F.stddev_samp(of_baseline(column)).alias("baseline_value"),
                     F.stddev_samp(of_current(column)).alias("current_value")),
            F.struct(F.lit("ignored").alias("statistic"),
                     F.count_if(~F.col("is_current") & F.col(column).isNull()).cast("double").alias("baseline_value"),
                     F.count_if(F.col("is_current") & F.col(column).isNull()).cast("double").alias("current_value")),
        ).alias("rows")
    ).select(F.inline("rows"))
    percent = F.round(F.col("quantile") * 100, 2).cast("string")
    percentiles = find(both, column, list(quantiles), by="is_current").groupBy("quantile").agg(
        F.max(of_baseline("value")).alias("baseline_value"), F.max(of_current("value")).alias("current_value"),
    ).select(
        F.concat(F.lit("p"), F.regexp_replace(percent, r"\.0$", "")).alias("statistic"),
        "baseline_value", "current_value",
    )
    return spread.unionByName(percentiles).withColumn("delta", F.col("current_value") - F.col("baseline_value"))


def group_mean_shift(base: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """Mean per category in both snapshots; a category missing on one side has a NULL mean there."""
    return (
        tagged(base, current, key, value)
        .groupBy(key)
        .agg(F.avg(of_baseline(value)).alias("baseline_mean"), F.avg(of_current(value)).alias("current_mean"))
        .withColumn("delta", F.col("current_mean") - F.col("baseline_mean"))
    )
