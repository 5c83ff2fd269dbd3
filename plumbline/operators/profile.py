"""Profiling: samples, counts, distributions and column summaries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import ColumnLike, col


def sample_rows(df: DataFrame, n: int, order_by: Iterable[str | Column]) -> DataFrame:
    """The first ``n`` rows in a stated order; each task keeps only its own ``n``."""
    return df.orderBy(*order_by).limit(n)


def project_preview(df: DataFrame, columns: Iterable[str], n: int, order_by: Iterable[str | Column]) -> DataFrame:
    """As ``sample_rows`` for some columns only; the scan reads no others than
    these and the ordering columns."""
    return df.orderBy(*order_by).limit(n).select(*columns)


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total_rows"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n), most frequent first. Counting combines before the shuffle, so
    a hot value costs one row per task."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(column))


def group_mean(df: DataFrame, key: str, value: ColumnLike, name: str = "mean_value") -> DataFrame:
    return df.groupBy(key).agg(F.avg(col(value)).alias(name)).orderBy(F.desc(name), F.asc(key))


def column_summary(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """COUNT, SUM, AVG, MIN and MAX of numeric columns from one pass.

    A double holds integers up to 2^53 only. For integer and decimal columns
    ``exact_sum``, ``exact_min`` and ``exact_max`` hold the decimal digits as text;
    they are NULL for other columns.
    """
    columns = list(columns)
    aggregates = []
    for c in columns:
        x, kind = F.col(c).cast("double"), df.schema[c].dataType
        is_exact = isinstance(kind, (T.IntegralType, T.DecimalType))
        scale = kind.scale if isinstance(kind, T.DecimalType) else 0

        def exact(aggregate: Column) -> Column:
            return aggregate.cast(f"decimal(38,{scale})").cast("string") if is_exact else F.lit(None).cast("string")

        # 28 digits leave the sum ten more, enough for 10^10 of the largest values
        digits = F.col(c).cast(f"decimal(28,{scale})") if is_exact and not isinstance(kind, T.DecimalType) else F.col(c)
        aggregates.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(x).alias("n_values"),
                F.sum(x).alias("sum_value"),
                F.avg(x).alias("avg_value"),
                F.min(x).alias("min_value"),
                F.max(x).alias("max_value"),
                exact(F.sum(digits)).alias("exact_sum"), exact(F.min(F.col(c))).alias("exact_min"), exact(F.max(F.col(c))).alias("exact_max"),
            ).alias(c)
        )
    wide = df.agg(*aggregates)
    return wide.select(F.inline(F.array(*(F.col(c) for c in columns))))
