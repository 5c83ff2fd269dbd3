"""The one schema every check reports in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocabulary as V
from ..functions.columns import share
from ..session import durable

FINDING_COLUMNS = (
    "check", "table_name", "column_name", "issue_type", "n_bad", "n_rows", "rate", "example", "confidence",
)


def finding(check: str, table_name: str, column_name: str, issue_type: str, n_bad: Column, n_rows: Column,
            example: Column | None = None, rate: Column | None = None) -> Column:
    """One findings row as a struct, for use in a projection over counts."""
    example = F.lit(None) if example is None else example
    return F.struct(
        F.lit(check).alias("check"),
        F.lit(table_name).alias("table_name"),
        F.lit(column_name).alias("column_name"),
        F.lit(issue_type).alias("issue_type"),
        n_bad.cast("bigint").alias("n_bad"),
        n_rows.cast("bigint").alias("n_rows"),
        (share(n_bad, n_rows) if rate is None else rate.cast("double")).alias("rate"),
        example.cast("string").alias("example"),
        F.lit(V.CONFIDENCE[issue_type]).alias("confidence"),
    )


def as_rows(df: DataFrame, *findings: Column) -> DataFrame:
    """The findings computed from each row of ``df``, one output row per finding."""
    return df.select(F.inline(F.array(*findings)))


def all_findings(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def written(findings: DataFrame) -> DataFrame:
    """The findings of an audit kept in the checkpoint folder: every check is evaluated once,
    by now, and graders, reports and comparisons read the few rows it gave."""
    return durable(findings.repartition(1))  # a row per check
