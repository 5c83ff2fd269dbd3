"""Values against the type, format and range they should have."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocabulary as V
from ..functions.columns import (
    date_needs_reformat, number_needs_cleaning, out_of_range, parsed_number, text_date, unparseable,
)


def _count(df: DataFrame, predicate: Column, name: str) -> DataFrame:
    return df.agg(F.count_if(predicate).alias(name))


def range_violations(df: DataFrame, column: str, lo=None, hi=None) -> DataFrame:
    return _count(df, out_of_range(column, lo, hi), "n_out_of_range")


def unparseable_count(df: DataFrame, column: str, count_nulls: bool = True) -> DataFrame:
    return _count(df, unparseable(column, count_nulls), "n_unparseable")


def type_violation_count(df: DataFrame, column: str) -> DataFrame:
    return _count(df, number_needs_cleaning(column), "n_type_violations")


def date_format_violation_count(df: DataFrame, column: str, fmt: str = V.TEXT_DATE_PARSE_FORMAT) -> DataFrame:
    return _count(df, date_needs_reformat(column, fmt), "n_date_format_violations")


def parse_numbers(df: DataFrame, column: str, keep: Iterable[str] = ()) -> DataFrame:
    """(kept columns, raw text, parsed number) for every row."""
    return df.select(*keep, column, parsed_number(column).alias(f"{column}_num"))


def parse_dates(df: DataFrame, column: str, keep: Iterable[str] = (),
                fmt: str = V.TEXT_DATE_PARSE_FORMAT) -> DataFrame:
    return df.select(*keep, column, text_date(column, fmt).alias(f"{column}_date"))


def violating_rows(df: DataFrame, predicate: Column) -> DataFrame:
    """The offending rows of any row check. A narrow filter, no shuffle."""
    return df.where(predicate)


def violation_examples(df: DataFrame, column: str, violations: dict[str, Column]) -> DataFrame:
    """(issue_type, n_bad, example) for several checks of one column. The
    example is the smallest offending value, so it never changes between runs."""
    issues = list(violations)
    # verdicts first, so that each predicate is evaluated once for both its count and its example
    judged = df.select(
        F.col(column).cast("string").alias("text"), *(bad.alias(f"bad_{i}") for i, bad in enumerate(violations.values()))
    )
    wide = judged.agg(
        *(
            F.struct(
                F.lit(issue).alias("issue_type"),
                F.count_if(f"bad_{i}").alias("n_bad"),
                F.min(F.when(F.col(f"bad_{i}"), F.col("text"))).alias("example"),
            ).alias(f"found_{i}")
            for i, issue in enumerate(issues)
        )
    )
    return wide.select(F.inline(F.array(*(F.col(f"found_{i}") for i in range(len(issues))))))
