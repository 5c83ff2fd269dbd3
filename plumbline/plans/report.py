"""From findings to an audit report: statements, recommended repairs, JSON.

A report states only what was found: findings with ``n_bad`` = 0 are left out.
Its rows have the layout that ``parse_reports`` makes of report texts, so an audit
can be graded without being written as text first.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import vocabulary as V
from .findings import all_findings

_ROW = ["section", "field", "issue_type", "value", "n_reported", "confidence"]


def _by_issue(mapping: dict[str, str]) -> Column:
    found = F.lit(None).cast("string")
    for issue, value in mapping.items():
        found = F.when(F.col("issue_type") == issue, value).otherwise(found)
    return found


def recommended_fixes(findings: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """(keys, issue_type, fix): the repair for every kind of issue found."""
    return (
        findings.where("n_bad > 0").select(*keys, "issue_type", _by_issue(V.FIXES).alias("fix"))
        .where("fix IS NOT NULL").distinct()
    )


def drifted_columns(findings: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """(keys, column_name, text, confidence): one row per drifted column. New
    categories are one list; several kinds of drift are joined by ``; ``."""
    keys = list(keys)
    drift = findings.where((F.col("n_bad") > 0) & (_by_issue(V.REPORT_SECTIONS) == "drift_details"))
    kinds = drift.groupBy(*keys, "column_name", "issue_type").agg(
        F.array_join(F.array_sort(F.collect_set(F.coalesce("example", F.lit("")))), ",").alias("text"), F.min("confidence").alias("confidence")
    )
    place = F.array_position(F.array(*map(F.lit, V.REPORT_SECTIONS)), F.col("issue_type"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), "text"))), lambda x: x["text"])
    return kinds.groupBy(*keys, "column_name").agg(
        F.array_join(texts, "; ").alias("text"), F.max_by("confidence", -place).alias("confidence")
    )


def report_rows(findings: DataFrame, keys: Iterable[str] = ()) -> DataFrame:
    """(keys, section, seq, field, issue_type, value, n_reported, confidence).

    ``keys`` tell reports apart when ``findings`` holds those of several runs.
    Missing values of a column are its ``missing`` count, or nulls and disguised
    nulls together where only those were asked for.
    """
    keys = list(keys)
    found = findings.where("n_bad > 0").withColumn("section", _by_issue(V.REPORT_SECTIONS))
    none = F.lit(None)
    count = F.col("n_bad").cast("string")

    whole = F.max(F.when(F.col("issue_type") == "missing", F.col("n_bad")))
    nulls = found.where("section = 'null_issues'").groupBy(*keys, "section", "column_name").agg(
        F.coalesce(whole, F.sum("n_bad")).alias("n_bad"), F.max("confidence").alias("confidence")
    ).select(*keys, "section", F.col("column_name").alias("field"), none.cast("string").alias("issue_type"), count.alias("value"),
             F.col("n_bad").alias("n_reported"), "confidence")
    copies = found.where("section = 'duplicate_row_count'").groupBy(*keys, "section").agg(
        F.sum("n_bad").alias("n_bad"), F.max("confidence").alias("confidence")
    ).select(*keys, "section", none.cast("string").alias("field"), none.cast("string").alias("issue_type"), count.alias("value"),
             F.col("n_bad").alias("n_reported"), "confidence")
    items = found.where("section IN ('schema_violations', 'relational_issues')").select(
        *keys, "section", F.col("column_name").alias("field"), "issue_type", F.col("example").alias("value"), F.col("n_bad").alias("n_reported"), "confidence"
    )
    drifted = drifted_columns(findings, keys)
    details = drifted.select(
        *keys, F.lit("drift_details").alias("section"), F.col("column_name").alias("field"), none.cast("string").alias("issue_type"),
        F.col("text").alias("value"), none.cast("bigint").alias("n_reported"), "confidence",
    )

    def listed(rows: DataFrame, section: str, column: str) -> DataFrame:
        return rows.select(
            *keys, F.lit(section).alias("section"), F.col(column).alias("field"), none.cast("string").alias("issue_type"),
            F.col(column).alias("value"), none.cast("bigint").alias("n_reported"), none.cast("double").alias("confidence"),
        ).distinct()

    rows = all_findings(
        nulls, copies, items, details, listed(drifted, "drifted_columns", "column_name"),
        listed(recommended_fixes(findings, keys), "recommended_fixes", "fix"),
    )
    order = Window.partitionBy(*keys, "section").orderBy("field", "issue_type", "value")  # a few statements of one report
    return rows.withColumn("seq", F.row_number().over(order) - 1).select(*keys, "section", "seq", *_ROW[1:])


def report_json(rows: DataFrame, keys: Iterable[str]) -> DataFrame:
    """(keys, report): the report of each run as JSON text."""
    keys = list(keys)

    def of(section: str, value: Column) -> Column:
        entries = F.array_sort(F.collect_list(F.when(F.col("section") == section, F.struct("seq", value.alias("x")))))
        return F.transform(entries, lambda e: e["x"])

    counted = F.struct(F.col("n_reported").alias("value"), "confidence")
    said = F.struct("value", "confidence")
    item = F.struct(F.col("field").alias("column"), "issue_type", F.col("value").alias("example"), F.col("n_reported").alias("count"), "confidence")
    copies = of("duplicate_row_count", counted)
    body = F.struct(
        F.map_from_entries(of("null_issues", F.struct("field", counted.alias("of")))).alias("null_issues"),
        F.when(F.size(copies) > 0, copies[0]).otherwise(F.struct(F.lit(0).cast("bigint").alias("value"), F.lit(V.DEFAULT_CONFIDENCE).alias("confidence"))).alias("duplicate_row_count"),
        of("schema_violations", item).alias("schema_violations"),
        of("drifted_columns", F.col("field")).alias("drifted_columns"),
        F.map_from_entries(of("drift_details", F.struct("field", said.alias("of")))).alias("drift_details"),
        of("relational_issues", item).alias("relational_issues"),
        of("recommended_fixes", F.col("field")).alias("recommended_fixes"),
    )
    return rows.groupBy(*keys).agg(F.to_json(body).alias("report"))
