"""Checks between tables.

Counts fold the child table to one row per key before any join, so the join
sees distinct keys and a hot key weighs as much as any other. Rows without a
parent are one anti join of two scans, which adaptive execution splits when a
key is hot. Parents without a child are one anti join too, with the distinct child keys,
since the child side there is large and repeats its keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocabulary as V
from ..functions.columns import ColumnLike, col, ends_before_start


def orphan_count(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows without a parent; a NULL key has none. One scan of either table."""
    counts = child.groupBy(fk).agg(F.count(F.lit(1)).alias("n_rows"))
    known = parent.select(F.col(pk).alias(fk)).distinct()
    return counts.join(known, fk, "left_anti").agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("orphan_count"))


def orphan_rows(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """The rows without a parent, NULL keys included."""
    known = parent.select(F.col(pk).alias("__pk"))
    return child.join(known, child[fk] == known["__pk"], "left_anti")


def temporal_violations(df: DataFrame, start: ColumnLike, end: ColumnLike) -> DataFrame:
    """Rows that end before they start. For columns of two tables join them
    first; both join sides then come straight from a scan, which is the case
    adaptive execution splits when a key is hot."""
    return df.where(ends_before_start(start, end))


def temporal_violation_count(df: DataFrame, start: ColumnLike, end: ColumnLike) -> DataFrame:
    return df.agg(F.count_if(ends_before_start(start, end)).alias("temporal_count"))


def reconciled_totals(parent: DataFrame, pk: str, total: str, child: DataFrame, fk: str, amount: ColumnLike,
                      include_childless: bool = False, parent_is_unique: bool = False) -> DataFrame:
    """(pk, total, line_total): every stored total next to the sum of its lines.

    The child is summed per key before the join. A parent row that occurs
    several times meets its lines as often, so repeated (key, total) pairs are
    folded with a count first; ``parent_is_unique=True`` skips that for a
    declared key. ``include_childless`` keeps parents without lines, with a line
    total of 0.
    """
    lines = child.groupBy(F.col(fk).alias(pk)).agg(F.sum(col(amount)).alias("line_sum"))
    totals = parent.select(pk, total)
    if parent_is_unique:
        totals = totals.withColumn("times", F.lit(1))
    else:
        totals = totals.groupBy(pk, total).agg(F.count(F.lit(1)).alias("times"))
    joined = totals.join(lines, pk, "left" if include_childless else "inner")
    line_total = F.col("line_sum") * F.col("times")
    if include_childless:
        line_total = F.coalesce(line_total, F.lit(0.0))
    return joined.select(pk, total, line_total.alias("line_total"))


def is_mismatch(total: str, tolerance: float = V.AMOUNT_TOLERANCE) -> Column:
    return F.abs(F.col(total) - F.col("line_total")) > tolerance


def aggregate_mismatches(parent: DataFrame, pk: str, total: str, child: DataFrame, fk: str, amount: ColumnLike,
                         tolerance: float = V.AMOUNT_TOLERANCE, **options) -> DataFrame:
    """The reconciled totals that are off by more than ``tolerance``."""
    return reconciled_totals(parent, pk, total, child, fk, amount, **options).where(is_mismatch(total, tolerance))


def aggregate_mismatch_count(*args, **options) -> DataFrame:
    return aggregate_mismatches(*args, **options).agg(F.count(F.lit(1)).alias("aggregate_count"))


def _childless_keys(parent: DataFrame, pk: str, child: DataFrame, fk: str) -> DataFrame:
    counts = parent.groupBy(pk).agg(F.count(F.lit(1)).alias("n_rows"))
    known = child.select(F.col(fk).alias(pk)).distinct()
    return counts.join(known, pk, "left_anti")


def childless_parents(parent: DataFrame, pk: str, child: DataFrame, fk: str) -> DataFrame:
    """Parent rows no child points to; a NULL key has no children. One scan of either table.

    Child keys are folded to distinct ones in every task before they move. They meet the
    parents as structs, a key they are not placed on yet: so both sides of the join come straight
    from a shuffle, and adaptive execution splits a hot parent key."""
    known = child.select(F.col(fk).try_cast(parent.schema[pk].dataType).alias("__fk")).where("__fk IS NOT NULL").distinct()
    return parent.join(known, F.struct(F.col(pk).alias("k")) == F.struct(F.col("__fk").alias("k")), "left_anti")


def childless_count(parent: DataFrame, pk: str, child: DataFrame, fk: str) -> DataFrame:
    return _childless_keys(parent, pk, child, fk).agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("childless_count")
    )
