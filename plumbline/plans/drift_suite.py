"""Drift between two snapshots, all checks of a table pair fused.

Each snapshot is scanned three times, whatever the number of checks: once for sizes,
means, deviations and the sketches that bracket percentiles; once, if these are to be
exact, for the few values inside the brackets; once for the values of categories and
references, counted on both sides in one shuffle. The answers are those of the single
checks in ``operators/drift.py``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import vocabulary as V
from ..functions.columns import share
from ..operators import drift as D
from ..operators.quantiles import APPROXIMATE, bracket_of, interpolated, sketch, usable
from .findings import all_findings, as_rows, finding


def _name(quantile: float) -> str:
    return f"p{round(quantile * 100, 2):g}"


def snapshot_statistics(base: DataFrame, current: DataFrame, measures: Iterable[str] = (), distributions: Iterable[str] = (),
                        quantiles: Iterable[float] = (0.25, 0.5, 0.75), exact: bool = True) -> DataFrame:
    """One row: ``n_b`` and ``n_c`` rows; for the i-th measure ``mean_i_b``, ``mean_i_c``; for
    the j-th distribution ``sd_j_…`` and for its k-th quantile ``q_j_k_…``. ``b`` is the
    baseline, ``c`` the current snapshot; what a snapshot has no value for is NULL."""
    measures, distributions, quantiles = list(measures), list(distributions), [float(q) for q in quantiles]
    both = D.tagged(base, current, *dict.fromkeys([*measures, *distributions]))
    values = {j: usable(c) for j, c in enumerate(distributions)}
    found: list[Column] = [F.count(F.lit(1)).alias("n")]
    found += [F.avg(c).cast("double").alias(f"mean_{i}") for i, c in enumerate(measures)]
    for j, v in values.items():
        found += [F.stddev_samp(v).alias(f"sd_{j}"), F.count(v).alias(f"total_{j}"), F.min(v).alias(f"least_{j}"), F.max(v).alias(f"most_{j}"),
                  (sketch(v, quantiles) if exact else F.percentile_approx(v, quantiles, APPROXIMATE)).alias(f"cuts_{j}")]
    sides = both.groupBy("is_current").agg(*found)  # two rows
    plain = ["n", *(f"mean_{i}" for i in range(len(measures))), *(f"sd_{j}" for j in values)]
    quantile_names = [(j, k, f"q_{j}_{k}") for j in values for k in range(len(quantiles))]
    if exact and distributions:
        told = F.struct(*plain).alias("told")
        brackets = [
            F.struct(F.lit(j).alias("j"), F.lit(k).alias("k"), F.col(f"total_{j}").alias("total"),
                     *bracket_of(q, F.col(f"total_{j}"), F.col(f"least_{j}"), F.col(f"most_{j}"), F.col(f"cuts_{j}"), k, len(quantiles)))
            for j in values for k, q in enumerate(quantiles)
        ]
        asked = sides.select("is_current", told, F.array(*brackets).alias("brackets"))
        # the columns' values beside the brackets; two rows are broadcast
        near = both.select("is_current", F.array(*values.values()).alias("vs")).join(F.broadcast(asked), "is_current").select(
            "is_current", "told", "vs", F.inline("brackets")
        ).withColumn("v", F.get("vs", F.col("j")))
        keys = ["is_current", "told", "j", "k", "quantile", "total"]
        folded = near.groupBy(*keys, F.when((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")), F.col("v")).alias("v")).agg(
            F.count_if(F.col("v") <= F.col("high")).alias("n")
        )
        sides = interpolated(folded, keys).select("is_current", "told.*", "j", "k", "value")
        of_quantile = {name: F.when((F.col("j") == j) & (F.col("k") == k), F.col("value")) for j, k, name in quantile_names}
    else:
        of_quantile = {name: F.col(f"cuts_{j}")[k] for j, k, name in quantile_names}
    wanted = {c: F.col(c) for c in plain} | of_quantile
    return sides.agg(*(
        F.max(F.when(side, value)).alias(f"{name}_{tag}")
        for name, value in wanted.items() for tag, side in (("b", ~F.col("is_current")), ("c", F.col("is_current")))
    ))


def _moved(b: Column, c: Column, limit: Column) -> Column:
    """Whether a statistic moved by more than ``limit``; one that is NULL on one side only has."""
    return F.coalesce(F.abs(c - b) > limit, b.isNull() != c.isNull())


def numeric_findings(base: DataFrame, current: DataFrame, table_name: str, measures: Iterable[str], distributions: Iterable[str],
                     min_move: float = V.MIN_MOVE, exact: bool = True, quantiles: Iterable[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """A mean-shift finding per measure and a distribution finding per distribution."""
    measures, distributions, quantiles = list(measures), list(distributions), list(quantiles)
    stats = snapshot_statistics(base, current, measures, distributions, quantiles, exact)
    n, found = F.coalesce("n_c", F.lit(0).cast("bigint")), []
    for i, column in enumerate(measures):
        b, c = F.col(f"mean_{i}_b"), F.col(f"mean_{i}_c")
        shown = [F.when(x.isNull(), "none").otherwise(F.format_string("%.2f", x)) for x in (b, c)]
        found.append(finding(
            "mean_shift", table_name, column, "mean_shift", F.when(_moved(b, c, F.lit(min_move) * F.abs(b)), n).otherwise(0), n,
            F.concat(F.lit("mean shift from "), shown[0], F.lit(" to "), shown[1]), rate=F.abs(c - b) / F.abs(F.nullif(b, F.lit(0.0))),
        ))
    for j, column in enumerate(distributions):
        pairs = {"stddev": f"sd_{j}", **{_name(q): f"q_{j}_{k}" for k, q in enumerate(quantiles)}}
        spread = F.col(f"sd_{j}_b")
        moves = {name: F.abs(F.col(f"{c}_c") - F.col(f"{c}_b")) for name, c in pairs.items()}
        names = F.array_sort(F.array_compact(F.array(*(
            F.when(_moved(F.col(f"{c}_b"), F.col(f"{c}_c"), F.lit(min_move) * spread), name) for name, c in pairs.items()
        ))))
        found.append(finding(
            "distribution_shift", table_name, column, "distribution_shift", F.when(F.size(names) > 0, n).otherwise(0), n,
            F.when(F.size(names) > 0, F.concat(F.lit("moved: "), F.array_join(names, ", "))),
            rate=F.array_max(F.array(*moves.values())) / F.nullif(spread, F.lit(0.0)),
        ))
    return as_rows(stats, *found)


def value_counts_of_both(base: DataFrame, current: DataFrame, columns: Iterable[str]) -> DataFrame:
    """(k, v, n_base, n_current): rows per value (as text) of the k-th column, on both sides."""
    columns = list(columns)
    each = F.array(*(F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("v")) for k, c in enumerate(columns)))
    rows = D.tagged(base, current, *dict.fromkeys(columns)).select("is_current", F.inline(each))
    return rows.groupBy("k", "v").agg(F.count_if(~F.col("is_current")).alias("n_base"), F.count_if(F.col("is_current")).alias("n_current"))


def key_findings(base: DataFrame, current: DataFrame, table_name: str, categories: Iterable[str], references: Iterable[str]) -> DataFrame:
    """A finding per category that only the current snapshot has, and one per reference
    column with the rows whose key the baseline never had (a NULL key is such a key, and
    no category)."""
    categories, references = list(categories), list(references)
    every = base.sparkSession.range(len(categories) + len(references)).select(  # a column of two empty snapshots has a finding too
        F.col("id").cast("int").alias("k"), F.lit(None).cast("string").alias("v"), *(F.lit(0).cast("bigint").alias(c) for c in ("n_base", "n_current"))
    )
    counts = value_counts_of_both(base, current, [*categories, *references]).unionByName(every)
    is_category, known = F.col("k") < len(categories), (F.col("n_base") > 0) & F.col("v").isNotNull()
    # per column one row for all it has, and one for each new category
    new = F.when(is_category & F.col("v").isNotNull() & (F.col("n_base") == 0), F.col("v"))
    folded = counts.groupBy("k", new.alias("category")).agg(
        F.sum("n_current").alias("n"), F.sum(F.when(known, 0).otherwise(F.col("n_current"))).alias("n_novel")
    )
    total = F.sum("n").over(Window.partitionBy("k"))  # as many rows as the column's new categories, which are findings each
    listed = folded.withColumn("total", total).where(F.col("category").isNotNull() | ~is_category)
    rate = F.format_string("%.1f%%", share(F.col("n_novel"), F.col("total")) * 100)
    each = [finding("new_category", table_name, c, "new_category", F.col("n"), F.col("total"), F.col("category")) for c in categories]
    each += [finding("novel_reference", table_name, c, "referential_drift", F.col("n_novel"), F.col("total"), rate) for c in references]
    return as_rows(listed, F.get(F.array(*each), F.col("k")))


def audit_drift(base: DataFrame, current: DataFrame, table_name: str, measures: Iterable[str] = (), categories: Iterable[str] = (),
                references: Iterable[str] = (), distributions: Iterable[str] = (), min_move: float = V.MIN_MOVE, exact: bool = True) -> DataFrame:
    """Means of ``measures``, spread and percentiles of ``distributions``, new
    ``categories``, unknown ``references``. ``exact=False`` reads percentiles
    from bounded sketches."""
    measures, categories, references, distributions = map(list, (measures, categories, references, distributions))
    parts = []
    if measures or distributions:
        parts.append(numeric_findings(base, current, table_name, measures, distributions, min_move, exact))
    if categories or references:
        parts.append(key_findings(base, current, table_name, categories, references))
    return all_findings(*parts)
