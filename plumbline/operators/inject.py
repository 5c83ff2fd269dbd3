"""Known faults for recall tests, on any table.

Rows are picked by a predicate over their key. That needs no random state, no
shuffle and no driver: the same key gets the same fault on every run and in
every retried task, and the truth is the number of rows the predicate matches.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocabulary as V
from ..functions.columns import ColumnLike, col


def pick_rows(key: ColumnLike, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.pmod(col(key), F.lit(modulus)) == remainder, F.lit(False))


def truth(df: DataFrame, pick: Column, name: str = "n_injected") -> DataFrame:
    return df.agg(F.count_if(pick).alias(name))


def choice(values: Sequence, key: ColumnLike) -> Column:
    """One of the values, chosen by key."""
    index = (F.pmod(col(key), F.lit(len(values))) + 1).cast("int")
    return F.element_at(F.array(*map(F.lit, values)), index)


def _set(df: DataFrame, column: str, value: Column, pick: Column) -> DataFrame:
    kept = df.schema[column].dataType
    return df.withColumn(column, F.when(pick, value.cast(kept)).otherwise(F.col(column)))


def null_out(df: DataFrame, column: str, pick: Column) -> DataFrame:
    return _set(df, column, F.lit(None), pick)


def disguise(df: DataFrame, column: str, pick: Column, key: ColumnLike,
             tokens: Sequence[str] = V.DISGUISES) -> DataFrame:
    return _set(df, column, choice(tokens, key), pick)


def append_variants(df: DataFrame, *variants: tuple[Column, Mapping[str, Column]]) -> DataFrame:
    """``df`` and, for every (pick, changes), a copy of each picked row with the
    changed columns. All read the old row, in one scan: a row becomes an array of
    itself and its copies."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def row(changes: Mapping[str, Column]) -> Column:
        return F.struct(*(changes[c].cast(types[c]).alias(c) if c in changes else F.col(c) for c in df.columns))

    copies = (F.when(pick, row(changes)) for pick, changes in variants)
    rows = F.filter(F.array(row({}), *copies), lambda r: r.isNotNull())
    return df.select(F.inline(rows))


def append_copies(df: DataFrame, pick: Column) -> DataFrame:
    return append_variants(df, (pick, {}))


def append_near_copies(df: DataFrame, pick: Column, column: str, changed: Column) -> DataFrame:
    """``changed`` must differ from the old value; a copy it would leave equal is not added."""
    return append_variants(df, (pick & ~changed.eqNullSafe(F.col(column)), {column: changed}))


def negate(df: DataFrame, column: str, pick: Column) -> DataFrame:
    return _set(df, column, -F.abs(column), pick)


def as_currency_text(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.concat(F.lit(V.CURRENCY_SIGN), F.col(column).cast("decimal(18,2)").cast("string")))


def as_text_date(df: DataFrame, column: str, fmt: str = V.TEXT_DATE_FORMAT) -> DataFrame:
    return df.withColumn(column, F.date_format(column, fmt))


def spoil_numbers(df: DataFrame, column: str, pick: Column, key: ColumnLike,
                  markers: Sequence[str] = V.UNPARSEABLE_MARKERS) -> DataFrame:
    """Replace a number held as text by a marker no parser reads."""
    return _set(df, column, choice(markers, key), pick)


def scale_measure(df: DataFrame, column: str, factor: float) -> DataFrame:
    return df.withColumn(column, F.col(column) * F.lit(factor))


def add_categories(df: DataFrame, column: str, pick: Column, key: ColumnLike, categories: Sequence[str]) -> DataFrame:
    return _set(df, column, choice(categories, key), pick)


def shift_ids(df: DataFrame, column: str, pick: Column, offset: int) -> DataFrame:
    """Move keys out of their range: drifted references, or orphaned foreign keys."""
    return _set(df, column, F.col(column) + F.lit(offset), pick)


orphan_keys = shift_ids


def end_before_start(df: DataFrame, start: str, end: str, pick: Column, days: int = 1) -> DataFrame:
    return _set(df, end, F.col(start) - F.make_dt_interval(days=F.lit(days)), pick)


def inflate_totals(df: DataFrame, column: str, pick: Column, factor: float) -> DataFrame:
    return _set(df, column, F.col(column) * F.lit(factor), pick)
