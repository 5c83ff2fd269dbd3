"""Real and disguised nulls."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocabulary as V
from ..functions.columns import disguised_null, row_has_missing


def _per_column(df: DataFrame, columns: Iterable[str], counters: dict[str, Callable[[str], Column]]) -> DataFrame:
    """Count rows per column and predicate: one pass, then one row per column."""
    columns = list(columns)
    wide = df.agg(
        *(
            F.struct(
                F.lit(c).alias("column_name"),
                *(F.count_if(predicate(c)).alias(name) for name, predicate in counters.items()),
                F.count(F.lit(1)).alias("n_rows"),
            ).alias(c)
            for c in columns
        )
    )
    return wide.select(F.inline(F.array(*(F.col(f"`{c}`") for c in columns))))


def null_counts(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return _per_column(df, columns, {"n_null": lambda c: F.col(c).isNull()})


def disguised_null_counts(df: DataFrame, columns: Iterable[str],
                          tokens: Iterable[str] = V.NULL_TOKENS) -> DataFrame:
    tokens = tuple(tokens)
    return _per_column(df, columns, {"n_disguised": lambda c: disguised_null(c, tokens)})


def missing_counts(df: DataFrame, columns: Iterable[str], tokens: Iterable[str] = V.NULL_TOKENS) -> DataFrame:
    """Real, disguised and total missing values per column from one pass."""
    tokens = tuple(tokens)
    return _per_column(
        df,
        columns,
        {"n_null": lambda c: F.col(c).isNull(), "n_disguised": lambda c: disguised_null(c, tokens)},
    ).select(
        # a value is never both, so the total is their sum
        "column_name", "n_null", "n_disguised", (F.col("n_null") + F.col("n_disguised")).alias("n_missing"), "n_rows"
    )


def flag_null_rows(df: DataFrame, columns: Iterable[str], tokens: Iterable[str] = V.ROW_FLAG_TOKENS,
                   name: str = "has_missing") -> DataFrame:
    return df.withColumn(name, row_has_missing(list(columns), tuple(tokens)))
