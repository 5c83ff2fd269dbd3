"""Row checks of a table, fused.

Any number of checks whose verdict depends on one row only become one
aggregation: one scan, one row per task through one exchange, then one findings
row per check.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import columns as C, vocabulary as V
from .findings import as_rows, finding


@dataclass(frozen=True)
class RowCheck:
    """A named predicate over one row. Two checks with equal name, column and
    parameters are the same check."""

    check: str
    column: str
    issue_type: str
    parameters: tuple = ()
    bad: Column = field(default=None, compare=False)

    def text(self) -> Column:
        return F.col(self.column.split(",")[-1]).cast("string")


def null(column: str) -> RowCheck:
    return RowCheck("null", column, "null", (), F.col(column).isNull())


def disguised_null(column: str, tokens: Iterable[str] = V.NULL_TOKENS) -> RowCheck:
    tokens = tuple(tokens)
    return RowCheck("disguised_null", column, "disguised_null", tokens, C.disguised_null(column, tokens))


def missing(column: str, tokens: Iterable[str] = V.NULL_TOKENS) -> RowCheck:
    tokens = tuple(tokens)
    return RowCheck("missing", column, "missing", tokens, C.missing(column, tokens))


def in_range(column: str, lo=None, hi=None) -> RowCheck:
    return RowCheck("range", column, "out_of_range", (lo, hi), C.out_of_range(column, lo, hi))


def not_negative(column: str) -> RowCheck:
    return RowCheck("not_negative", column, "negative_value", (), C.out_of_range(column, 0))


def number_type(column: str) -> RowCheck:
    return RowCheck("number_type", column, "type_violation", (), C.number_needs_cleaning(column))


def parseable(column: str, count_nulls: bool = True) -> RowCheck:
    return RowCheck("parseable", column, "unparseable", (count_nulls,), C.unparseable(column, count_nulls))


def iso_format(column: str, fmt: str = V.TEXT_DATE_PARSE_FORMAT) -> RowCheck:
    return RowCheck("iso_format", column, "date_format_violation", (fmt,), C.date_needs_reformat(column, fmt))


def ordered(start: str, end: str) -> RowCheck:
    return RowCheck("ordered", f"{start},{end}", "temporal_violation", (), C.ends_before_start(start, end))


def run_checks(df: DataFrame, table_name: str, checks: Iterable[RowCheck]) -> DataFrame:
    """Findings of all checks from one pass. Repeated checks run once. The
    example is the smallest offending value."""
    checks = list(dict.fromkeys(checks))
    # verdicts first, so that each predicate is evaluated once for both its count and its example
    judged = df.select(
        *(c.bad.alias(f"bad_{i}") for i, c in enumerate(checks)),
        *(c.text().alias(f"text_{i}") for i, c in enumerate(checks)),
    )
    counted = judged.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *(F.count_if(f"bad_{i}").alias(f"bad_{i}") for i in range(len(checks))),
        *(F.min(F.when(F.col(f"bad_{i}"), F.col(f"text_{i}"))).alias(f"example_{i}") for i in range(len(checks))),
    )
    return as_rows(
        counted,
        *(
            finding(c.check, table_name, c.column, c.issue_type, F.col(f"bad_{i}"), F.col("n_rows"),
                    F.col(f"example_{i}"))
            for i, c in enumerate(checks)
        ),
    )


def failing_rows(df: DataFrame, checks: Iterable[RowCheck], name: str = "failed") -> DataFrame:
    """Rows that fail any check, with the names of the ones they fail."""
    checks = list(dict.fromkeys(checks))
    failed = F.array_compact(F.array(*(F.when(c.bad, F.lit(f"{c.check}:{c.column}")) for c in checks)))
    return df.withColumn(name, failed).where(F.size(name) > 0)


def passes(checks: Iterable[RowCheck]) -> Column:
    """True where a row passes every check."""
    return ~C.any_of(F.coalesce(c.bad, F.lit(False)) for c in dict.fromkeys(checks))
