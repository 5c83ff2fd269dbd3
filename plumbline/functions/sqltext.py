"""Column expressions over a column of SQL text (a query log)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import vocabulary as V
from .columns import ColumnLike, any_of, col


def is_read_only(sql: ColumnLike) -> Column:
    return col(sql).rlike(f"(?i){V.READ_ONLY_PATTERN}")


def is_destructive(sql: ColumnLike, words=V.DESTRUCTIVE_STATEMENTS) -> Column:
    return col(sql).rlike(rf"(?i)\b({'|'.join(words)})\b")


def statement(sql: ColumnLike) -> Column:
    """The text without outer whitespace and closing semicolons."""
    outer = F.regexp_replace(F.coalesce(col(sql), F.lit("")), r"^\s+|\s+$", "")
    return F.regexp_replace(outer, r";+$", "")


def statement_key(text: ColumnLike) -> Column:
    return F.lower(F.regexp_replace(col(text), r"\s+", " "))


def query_key(sql: ColumnLike) -> Column:
    """Equal for texts that differ only in case, spacing and a closing semicolon."""
    return statement_key(statement(sql))


def referenced_tables(sql: ColumnLike) -> Column:
    """Sorted distinct last name parts after FROM / JOIN, in lower case."""
    names = F.regexp_extract_all(col(sql), F.lit(f"(?i){V.TABLE_REFERENCE_PATTERN}"), F.lit(1))
    last = F.transform(names, lambda n: F.lower(F.element_at(F.split(n, r"\."), -1)))
    return F.array_sort(F.array_distinct(F.filter(last, lambda n: n != "")))


def feature(sql: ColumnLike, name: str) -> Column:
    lowered = F.lower(F.coalesce(col(sql), F.lit("")))
    return any_of(lowered.contains(w) for w in V.QUERY_FEATURES[name])
