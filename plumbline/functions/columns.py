"""Row predicates and conversions as plain column expressions.

Everything here is built from JVM-side functions, so a check made of these
stays inside whole-stage code generation and needs no Python worker.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from . import vocabulary as V

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def share(part: Column, whole: Column) -> Column:
    """part / whole as DOUBLE, 0 for an empty whole."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


# --- missing values -------------------------------------------------------
def disguised_null(c: ColumnLike, tokens: Iterable[str] = V.NULL_TOKENS) -> Column:
    """A value that only spells "no value". False (not NULL) for a real NULL."""
    text = F.lower(F.trim(col(c).cast("string")))
    return F.coalesce(text.isin(*tokens), F.lit(False))


def missing(c: ColumnLike, tokens: Iterable[str] = V.NULL_TOKENS) -> Column:
    return col(c).isNull() | disguised_null(c, tokens)


# --- numbers held as text -------------------------------------------------
def without_currency(c: ColumnLike) -> Column:
    return F.replace(col(c).cast("string"), F.lit(V.CURRENCY_SIGN), F.lit(""))


def number_or_null(text: Column) -> Column:
    """DOUBLE where the text is a plain number. The pattern keeps out suffix
    and separator spellings that one engine reads and another does not."""
    return F.when(text.rlike(V.NUMBER_PATTERN), F.trim(text).try_cast("double"))


def parsed_number(c: ColumnLike) -> Column:
    return number_or_null(without_currency(c))


def unparseable(c: ColumnLike, count_nulls: bool = True) -> Column:
    bad = parsed_number(c).isNull()
    return bad if count_nulls else bad & col(c).isNotNull()


def number_needs_cleaning(c: ColumnLike) -> Column:
    """Not a number as stored, but one once the currency sign is gone."""
    return number_or_null(col(c).cast("string")).isNull() & parsed_number(c).isNotNull()


# --- dates held as text ---------------------------------------------------
def iso_date(c: ColumnLike) -> Column:
    text = col(c).cast("string")
    return F.when(text.rlike(V.ISO_DATE_PATTERN), text.try_cast("date"))


def text_date(c: ColumnLike, fmt: str = V.TEXT_DATE_PARSE_FORMAT) -> Column:
    return F.try_to_date(col(c).cast("string"), fmt)


def date_needs_reformat(c: ColumnLike, fmt: str = V.TEXT_DATE_PARSE_FORMAT) -> Column:
    return iso_date(c).isNull() & text_date(c, fmt).isNotNull()


# --- ranges and order -----------------------------------------------------
def out_of_range(c: ColumnLike, lo=None, hi=None) -> Column:
    """Outside [lo, hi]; the bounds themselves pass. NULL passes."""
    sides = []
    if lo is not None:
        sides.append(col(c) < F.lit(lo))
    if hi is not None:
        sides.append(col(c) > F.lit(hi))
    return F.coalesce(any_of(sides), F.lit(False))


def ends_before_start(start: ColumnLike, end: ColumnLike) -> Column:
    """Both sides read as timestamps; an unreadable side never counts."""
    earlier = col(end).try_cast("timestamp_ntz") < col(start).try_cast("timestamp_ntz")
    return F.coalesce(earlier, F.lit(False))


def row_has_missing(columns: Iterable[str], tokens: Iterable[str] = V.ROW_FLAG_TOKENS) -> Column:
    return any_of(missing(c, tokens) for c in columns)
