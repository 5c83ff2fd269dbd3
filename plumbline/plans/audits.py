"""The four audits, each a set of findings."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..operators import drift as D, duplicates as U, relational as R
from ..functions import vocabulary as V
from ..functions.columns import share
from . import suite
from .drift_suite import audit_drift
from .findings import all_findings, as_rows, finding


def duplicate_findings(df: DataFrame, table_name: str, columns: Iterable[str], anchors: Iterable[str] = (),
                       max_changed: int = 1) -> DataFrame:
    """Exact and near duplicates. Both read the same counted records, a shuffle
    Spark runs once. ``n_bad`` is the rows beyond the first copy, or the records
    in near-duplicate groups; the example of the latter tells how many groups
    and rows those are."""
    columns, anchors = list(columns), list(anchors)
    zero = F.lit(0).cast("bigint")
    exact = U.distinct_records(df, columns).agg(
        F.sum(F.col("n_copies") - 1).alias("exact"), F.sum("n_copies").alias("n"),
        *(zero.alias(c) for c in ("near", "n_groups", "n_near_rows")),
    )
    near = U.near_duplicate_groups(df, columns, anchors, max_changed).agg(
        zero.alias("exact"), zero.alias("n"), F.sum("n_new").alias("near"),
        F.count(F.lit(1)).alias("n_groups"), F.sum("n_rows").alias("n_near_rows"),
    )
    both = exact.unionByName(near).agg(
        *(F.coalesce(F.sum(c), zero).alias(c) for c in exact.columns)
    )
    groups = F.format_string("%d groups, %d rows", "n_groups", "n_near_rows")
    name = ",".join(columns)
    return as_rows(
        both,
        finding("exact_duplicates", table_name, name, "exact_duplicate", F.col("exact"), F.col("n")),
        finding("near_duplicates", table_name, name, "near_duplicate_pattern", F.col("near"), F.col("n"),
                groups),
    )


def exact_duplicate_finding(df: DataFrame, table_name: str, columns: Iterable[str]) -> DataFrame:
    columns = list(columns)
    counts = U.distinct_records(df, columns).agg(
        F.coalesce(F.sum(F.col("n_copies") - 1), F.lit(0)).alias("bad"), F.coalesce(F.sum("n_copies"), F.lit(0)).alias("n")
    )
    return as_rows(
        counts, finding("exact_duplicates", table_name, ",".join(columns), "exact_duplicate", F.col("bad"), F.col("n"))
    )


def audit_nulls_duplicates(df: DataFrame, table_name: str, missing: Iterable[str], nulls: Iterable[str],
                           records: Iterable[str], anchors: Iterable[str] = ()) -> DataFrame:
    """Missing values (real or disguised) of ``missing``, real nulls of
    ``nulls``, duplicates over ``records``."""
    checks = [*(suite.missing(c) for c in missing), *(suite.null(c) for c in nulls)]
    return all_findings(
        suite.run_checks(df, table_name, checks),
        duplicate_findings(df, table_name, records, anchors),
    )


def audit_conformance(df: DataFrame, table_name: str, amounts: Iterable[str] = (), dates: Iterable[str] = (),
                      not_negative: Iterable[str] = ()) -> DataFrame:
    """Type, parse, date-format and sign checks from one scan."""
    amounts = list(amounts)
    return suite.run_checks(df, table_name, [
        *(suite.number_type(c) for c in amounts),
        *(suite.iso_format(c) for c in dates),
        *(suite.not_negative(c) for c in not_negative),
        *(suite.parseable(c) for c in amounts),
    ])


def mean_shift_finding(base: DataFrame, current: DataFrame, table_name: str, column: str,
                       min_move: float = V.MIN_MOVE) -> DataFrame:
    """``n_bad`` is all current rows once the mean moved by more than ``min_move``
    of the baseline mean; ``rate`` is that relative move. A mean that is NULL in
    one snapshot only (all values gone, or the first ones) has moved."""
    means = D.tagged(base, current, column).agg(
        F.avg(D.of_baseline(column)).alias("b"), F.avg(D.of_current(column)).alias("c"),
        F.count_if(F.col("is_current")).alias("n"),
    )
    moved = F.abs(F.col("c") - F.col("b")) > F.lit(min_move) * F.abs("b")
    moved = F.coalesce(moved, F.col("b").isNull() != F.col("c").isNull())

    def shown(mean: str) -> Column:
        return F.when(F.col(mean).isNull(), "none").otherwise(F.format_string("%.2f", mean))

    text = F.concat(F.lit("mean shift from "), shown("b"), F.lit(" to "), shown("c"))
    return as_rows(
        means,
        finding("mean_shift", table_name, column, "mean_shift", F.when(moved, F.col("n")).otherwise(0), F.col("n"), text,
                rate=F.abs(F.col("c") - F.col("b")) / F.abs(F.nullif("b", F.lit(0.0)))),
    )


def distribution_finding(base: DataFrame, current: DataFrame, table_name: str, column: str,
                         quantiles: Iterable[float] = (0.25, 0.5, 0.75), min_move: float = V.MIN_MOVE, exact: bool = True) -> DataFrame:
    """``n_bad`` is all current rows once the standard deviation or a percentile
    moved by more than ``min_move`` baseline standard deviations; ``rate`` is the
    largest such move and the example names what moved. NULL on one side only has moved."""
    size = current.agg(F.count(F.lit(1))).scalar()
    stats = D.distribution_shift(base, current, column, quantiles, exact).where("statistic <> 'ignored'")
    spread = F.max(F.when(F.col("statistic") == "stddev", F.col("baseline_value"))).alias("spread")
    told = stats.agg(
        spread, F.collect_list(F.struct("statistic", "baseline_value", "current_value", F.abs("delta").alias("move"))).alias("rows")
    )
    moved = F.filter("rows", lambda r: F.coalesce(
        r["move"] > F.lit(min_move) * F.col("spread"), r["baseline_value"].isNull() != r["current_value"].isNull()
    ))
    names = F.array_sort(F.transform(moved, lambda r: r["statistic"]))
    judged = told.select(
        size.alias("n"), names.alias("names"), (F.array_max(F.transform("rows", lambda r: r["move"])) / F.nullif("spread", F.lit(0.0))).alias("rate")
    )
    return as_rows(
        judged,
        finding("distribution_shift", table_name, column, "distribution_shift", F.when(F.size("names") > 0, F.col("n")).otherwise(0), F.col("n"),
                F.when(F.size("names") > 0, F.concat(F.lit("moved: "), F.array_join("names", ", "))), rate=F.col("rate")),
    )


def new_category_findings(base: DataFrame, current: DataFrame, table_name: str, column: str) -> DataFrame:
    """One row per category only the current snapshot has; the table size is a
    scalar subquery."""
    size = current.agg(F.count(F.lit(1))).scalar()
    found = D.new_categories(base, current, column).select(
        F.col(column).cast("string").alias("category"), F.col("n_rows").alias("bad"), size.alias("n")
    )
    return as_rows(
        found,
        finding("new_category", table_name, column, "new_category", F.col("bad"), F.col("n"), F.col("category")),
    )


def reference_drift_finding(base: DataFrame, current: DataFrame, table_name: str, key: str) -> DataFrame:
    novel = D.novel_reference_share(base, current, key)
    text = F.format_string("%.1f%%", share(F.col("n_novel"), F.col("n_rows")) * 100)
    return as_rows(
        novel,
        finding("novel_reference", table_name, key, "referential_drift", F.col("n_novel"), F.col("n_rows"), text),
    )


def orphan_finding(child: DataFrame, child_name: str, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """The child is folded to (key, count) once; key by key it is either known,
    unknown or NULL, and the counts add up to the table."""
    counts = child.groupBy(fk).agg(F.count(F.lit(1)).alias("n"))
    known = parent.select(F.col(pk).alias(fk)).distinct().withColumn("known", F.lit(True))
    judged = counts.join(known, fk, "left")
    unknown = F.col("known").isNull()
    totals = judged.agg(
        F.coalesce(F.sum(F.when(unknown, F.col("n"))), F.lit(0)).alias("bad"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_all"),
        F.min(F.when(unknown, F.col(fk).cast("string"))).alias("example"),
    )
    return as_rows(
        totals, finding("orphans", child_name, fk, "orphaned_fk", F.col("bad"), F.col("n_all"), F.col("example"))
    )


def mismatch_finding(parent: DataFrame, parent_name: str, pk: str, total: str, child: DataFrame, fk: str, amount,
                     tolerance: float = V.AMOUNT_TOLERANCE) -> DataFrame:
    """``n_rows`` counts the (key, total) pairs that have lines."""
    lines = R.reconciled_totals(parent, pk, total, child, fk, amount)
    off = R.is_mismatch(total, tolerance)
    totals = lines.agg(
        F.count_if(off).alias("bad"), F.count(F.lit(1)).alias("n"),
        F.min(F.when(off, F.col(pk))).cast("string").alias("example"),
    )
    return as_rows(
        totals,
        finding("aggregate_mismatch", parent_name, total, "aggregate_mismatch", F.col("bad"), F.col("n"),
                F.col("example")),
    )


def audit_relational(orphans: Mapping | None = None, temporal: Mapping | None = None,
                     totals: Mapping | None = None) -> DataFrame:
    """Each argument holds the keyword arguments of one check:
    ``orphan_finding``, ``suite.run_checks`` (df, table_name, start, end) and
    ``mismatch_finding``. Each check scans its own tables: the time check needs
    single lines with their order, the totals lines folded per order, and a
    shuffle shared by both would carry whole lines where the fold carries sums."""
    parts = []
    if orphans:
        parts.append(orphan_finding(**orphans))
    if temporal:
        t = dict(temporal)
        parts.append(suite.run_checks(t["df"], t["table_name"], [suite.ordered(t["start"], t["end"])]))
    if totals:
        parts.append(mismatch_finding(**totals))
    return all_findings(*parts)


def full_audit(nulls_duplicates: Iterable[Mapping] = (), conformance: Iterable[Mapping] = (), drift: Iterable[Mapping] = (),
               relational: Iterable[Mapping] = ()) -> DataFrame:
    """All audits over any tables as one set of findings. Each argument lists the
    keyword arguments of calls to the audit of that name."""
    calls = (
        (audit_nulls_duplicates, nulls_duplicates), (audit_conformance, conformance), (audit_drift, drift),
        (audit_relational, relational),
    )
    parts = [audit(**arguments) for audit, many in calls for arguments in many]
    if not parts:
        raise ValueError("nothing to audit")
    return all_findings(*parts)
