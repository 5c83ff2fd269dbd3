"""Audit reports as JSON text -> one row per statement, and their merging.

Row layout: run keys, ``section``, ``seq`` (place in the report), ``field``
(map key or column), ``issue_type``, ``value``, ``n_reported``, ``confidence``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import vocabulary as V

_MAP_SECTIONS = ("null_issues", "drift_details")
_ITEM_SECTIONS = ("schema_violations", "relational_issues")
_LIST_SECTIONS = ("drifted_columns", "recommended_fixes")
_COUNT_SECTION = "duplicate_row_count"
SECTIONS = (*_MAP_SECTIONS, _COUNT_SECTION, *_ITEM_SECTIONS, *_LIST_SECTIONS)

_ROW = ["section", "seq", "field", "issue_type", "value", "n_reported", "confidence"]


_BODY_FIELDS = ("value", "confidence", "column", "issue_type", "example", "count")


def _as_count(text: Column) -> Column:
    # a failed cast is slow, so only text that starts like a number is tried
    return F.when(text.rlike(r"^\s*[+-]?\.?\d"), text.try_cast("double").try_cast("bigint"))


def _entries(section: Column, text: Column) -> Column:
    """The statements of a section as (field, body) with the body still text;
    NULL or empty where the section is missing or of the wrong type."""
    entry = "struct<field:string,body:string>"
    # text of the wrong shape is not even tried: a failed parse is slow
    as_object = F.when(F.ltrim(text).startswith("{"), text)
    as_list = F.when(F.ltrim(text).startswith("["), text)
    by_key = F.transform(
        F.map_entries(F.from_json(as_object, "map<string,string>")),
        lambda e: F.struct(e["key"].alias("field"), e["value"].alias("body")),
    )
    listed = F.transform(
        F.filter(F.from_json(as_list, "array<string>"), lambda e: e.isNotNull()),
        lambda e: F.struct(F.when(section.isin(*_LIST_SECTIONS), e).alias("field"), e.alias("body")),
    )
    single = F.array(F.struct(F.lit(None).cast("string").alias("field"), text.alias("body")))
    return (
        F.when(section.isin(*_MAP_SECTIONS), by_key.cast(f"array<{entry}>"))
        .when(section == _COUNT_SECTION, single.cast(f"array<{entry}>"))
        .otherwise(listed.cast(f"array<{entry}>"))
    )


def parse_reports(df: DataFrame, keys: Iterable[str], report: str = "report",
                  sections: Iterable[str] = SECTIONS) -> DataFrame:
    """Long rows of every report, or of some sections of it (the others are
    skipped over while reading). A missing or ill-typed section is empty, a
    missing duplicate count is 0 at even confidence; one bad value never loses
    the rest, because each level is read as text before its own parts are typed.
    Three row-wise steps (report -> sections -> statements), no shuffle."""
    keys, wanted = list(keys), [s for s in SECTIONS if s in set(sections)]
    texts = df.select(*keys, F.json_tuple(report, *wanted).alias(*wanted))
    by_section = texts.select(
        *keys, F.inline(F.array(*(F.struct(F.lit(s).alias("section"), F.col(s).alias("text")) for s in wanted)))
    )
    statements = by_section.select(
        *keys, "section", F.posexplode(_entries(F.col("section"), F.col("text"))).alias("seq", "entry")
    ).select(*keys, "section", "seq", "entry.field", "entry.body")
    own = [f"s_{name}" for name in _BODY_FIELDS]
    is_object = ~F.col("section").isin(*_LIST_SECTIONS) & F.ltrim("body").startswith("{")
    read = statements.select(
        *keys, "section", "seq", "field", "body",
        F.json_tuple(F.when(is_object, F.col("body")), *_BODY_FIELDS).alias(*own),
    )
    # a statement is {"value": …, "confidence": …} or a bare value at even confidence
    is_item = F.col("section").isin(*_ITEM_SECTIONS)
    is_list = F.col("section").isin(*_LIST_SECTIONS)
    is_count = F.col("section") == _COUNT_SECTION
    wrapped = F.coalesce(F.ltrim("body").startswith("{"), F.lit(False))
    stated = read.select(
        *keys, "section", "seq",
        F.when(is_item, F.col("s_column")).otherwise(F.col("field")).alias("field"),
        F.when(is_item, F.col("s_issue_type")).alias("issue_type"),
        F.when(is_item, F.col("s_example")).when(wrapped, F.col("s_value")).otherwise(F.col("body")).alias("value"),
        F.when(is_item, F.col("s_count")).when(wrapped, F.col("s_value")).when(~is_list, F.col("body")).alias("count"),
        F.when(wrapped, F.col("s_confidence")).alias("confidence"),
    )
    counted = stated.withColumns({
        "n_reported": F.when(is_count | is_item, F.coalesce(_as_count(F.col("count")), F.lit(0)))
        .otherwise(_as_count(F.col("count"))),
        "confidence": F.coalesce(F.col("confidence").try_cast("double"), F.lit(V.DEFAULT_CONFIDENCE)),
    })
    # for the duplicate count a confidence of zero reads as none given
    unsure = is_count & (F.col("confidence") == 0)
    return counted.select(
        *keys, "section", "seq", "field", "issue_type",
        F.when(is_count, F.col("n_reported").cast("string")).otherwise(F.col("value")).alias("value"),
        "n_reported",
        F.when(unsure, V.DEFAULT_CONFIDENCE).when(~is_list, F.col("confidence")).alias("confidence"),
    )


def merge_reports(first: DataFrame, second: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Two sets of report rows as one per run: map entries of the second
    override, the larger duplicate count wins, list entries occur once, and
    violations of both are kept in order. ``report`` tells the report (0 or 1) a
    statement comes from and ``seq`` its place there; in order of both they are
    the merged report. One aggregation."""
    keys = list(keys)
    # the second report's statements come after the first one's
    place = F.struct("priority", "seq")
    both = first.select(*keys, *_ROW, F.lit(0).alias("priority")).unionByName(
        second.select(*keys, *_ROW, F.lit(1).alias("priority"))
    )
    is_item = F.col("section").isin(*_ITEM_SECTIONS)
    statement = F.when(is_item, place)  # every violation is a statement of its own
    # a count: the larger; a map entry: the later; a list entry: the earlier
    rank = (
        F.when(F.col("section") == _COUNT_SECTION, F.col("n_reported"))
        .when(F.col("section").isin(*_LIST_SECTIONS), -F.col("priority"))
        .otherwise(F.col("priority"))
        .cast("bigint")
    )
    later = F.when(F.col("section").isin(*_LIST_SECTIONS), -F.col("seq")).otherwise(F.col("seq"))
    best = F.max(
        F.struct(
            rank.alias("rank"), later.alias("later"),
            "issue_type", "value", "n_reported", "confidence",
        )
    )
    merged = (
        both.groupBy(*keys, "section", F.when(~is_item, F.col("field")).alias("name"), statement.alias("statement"),
                     F.when(is_item, F.col("field")).alias("item_field"))
        .agg(best.alias("best"), F.min(place).alias("place"))
    )
    return merged.select(
        *keys, "section",
        F.col("place.priority").alias("report"), F.col("place.seq").alias("seq"),
        F.coalesce("name", "item_field").alias("field"),
        *(F.col(f"best.{c}") for c in ("issue_type", "value", "n_reported", "confidence")),
    )
