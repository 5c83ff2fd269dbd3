"""Null, duplicate and conformance checks on edge rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.functions import columns as C
from plumbline.operators import conformance as V, duplicates as U, nulls as N
from plumbline.plans import suite
from plumbline.plans.findings import FINDING_COLUMNS


# --- nulls ---------------------------------------------------------------------
@pytest.mark.parametrize("value, expected", [
    (None, False), ("NULL", True), ("Null", True), ("n/a", True), ("UNKNOWN", True), ("-", True), ("", True),
    ("   ", True), (" none ", True), ("0", True), ("na", False), ("\tnone", False), ("x", False), ("noné", False),
])
def test_disguised_null(spark, one, value, expected):
    df = spark.createDataFrame([(value,)], "c string")
    assert one(df.select(C.disguised_null("c").alias("d"), C.missing("c").alias("m"))) == {
        "d": expected, "m": expected or value is None,
    }


def test_numeric_zero_is_disguised_in_a_numeric_column(spark, rows):
    df = spark.createDataFrame([(0, 1.5), (7, None)], "i long, d double")
    assert rows(N.missing_counts(df, ["i", "d"])) == [("d", 1, 0, 1, 2), ("i", 0, 1, 1, 2)]


def test_counts_of_an_empty_table_are_zero(spark, rows, one):
    df = spark.createDataFrame([], "a string, b long")
    assert rows(N.missing_counts(df, ["a", "b"])) == [("a", 0, 0, 0, 0), ("b", 0, 0, 0, 0)]
    assert one(U.exact_duplicate_count(df, ["a", "b"])) == {"duplicate_rows": 0}
    assert one(V.unparseable_count(df, "a")) == {"n_unparseable": 0}
    found = suite.run_checks(df, "t", [suite.null("a"), suite.parseable("a")])
    assert [(r.n_bad, r.n_rows, r.rate, r.example) for r in found.collect()] == [(0, 0, 0.0, None)] * 2


def test_row_flag_uses_its_own_tokens(spark, rows):
    df = spark.createDataFrame([(1, "na"), (2, "0"), (3, None), (4, "ok")], "id long, c string")
    assert rows(N.flag_null_rows(df, ["c"]).select("id", "has_missing")) == [
        (1, True), (2, False), (3, True), (4, False),
    ]


# --- duplicates ------------------------------------------------------------------
RECORD = ["name", "country", "tier"]


def _people(spark, values):
    return spark.createDataFrame(values, "name string, country string, tier string")


def test_exact_duplicates_count_copies_beyond_the_first(spark, one):
    df = _people(spark, [("a", "x", "1")] * 3 + [(None, None, None)] * 2 + [("b", "x", "1")])
    assert one(U.exact_duplicate_count(df, RECORD)) == {"duplicate_rows": 3}
    assert one(U.exact_duplicate_count_wide(df, RECORD)) == {"duplicate_rows": 3}


def test_fingerprint_keeps_nearly_equal_records_apart(spark, one):
    at = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame(
        [("a", "bc", 0.0, at), ("ab", "c", 0.0, at), ("a", None, -0.0, at), ("a", "", 0.0, at),
         ("a", "", -0.0, at), ("a", "", 0.0, at + datetime.timedelta(microseconds=1))],
        "x string, y string, v double, t timestamp_ntz",
    )
    assert one(U.exact_duplicate_count(df, df.columns)) == {"duplicate_rows": 1}
    assert one(U.exact_duplicate_count_wide(df, df.columns)) == {"duplicate_rows": 1}


def test_near_duplicates_one_change(spark, rows):
    df = _people(spark, [("a", "x", "1"), ("a", "x", "1"), ("a", "y", "1"), ("b", None, "1"), ("b", "z", "1"),
                         ("c", "x", "1"), ("d", "x", "2")])
    assert rows(U.near_duplicate_groups(df, RECORD, anchors=["name"])) == [
        ("country", "a", None, "1", 2, 2, 3), ("country", "b", None, "1", 2, 2, 2),
    ]


def test_near_duplicates_two_changes_report_only_new_records(spark, rows):
    df = _people(spark, [("a", "x", "1"), ("a", "y", "2"), ("b", "x", "1"), ("b", "y", "1"), ("b", "z", "3"),
                         ("c", "x", "1"), ("c", "y", "1")])
    got = rows(U.near_duplicate_groups(df, RECORD, anchors=["name"], max_changed=2))
    assert got == [
        ("country", "b", None, "1", 2, 2, 2), ("country", "c", None, "1", 2, 2, 2),
        ("country,tier", "a", None, None, 2, 2, 2), ("country,tier", "b", None, None, 3, 1, 3),
    ]


def test_near_duplicates_agree_with_brute_force(spark):
    import itertools
    import random

    random.seed(7)
    values = [(random.choice("ab"), random.choice(["x", "y", None]), random.choice(["1", "2", "3", None]))
              for _ in range(60)]
    values += [("z", "x", str(i)) for i in range(30)]
    records = set(values)

    def differing(a, b):
        return tuple(i for i in range(3) if a[i] != b[i])

    links = [(a, b, differing(a, b)) for a, b in itertools.combinations(records, 2)]
    free = {(1,), (2,)}
    level1 = {r for a, b, d in links if d in free for r in (a, b)}
    level2 = {r for a, b, d in links if d == (1, 2) for r in (a, b)} - level1
    df = _people(spark, values)
    found = U.near_duplicate_groups(df, RECORD, anchors=["name"], max_changed=2)
    new = {r.left_out: 0 for r in found.collect()}
    for r in found.collect():
        new[r.left_out] += r.n_new
    ones = {i: {r for a, b, d in links if d == (i,) for r in (a, b)} for i in (1, 2)}
    assert new.get("country", 0) == len(ones[1]) and new.get("tier", 0) == len(ones[2])
    assert new.get("country,tier", 0) == len(level2)


def test_near_duplicates_need_anchors_for_two_changes(spark):
    df = _people(spark, [("a", "x", "1")])
    with pytest.raises(ValueError):
        U.near_duplicate_groups(df, RECORD, max_changed=2)
    with pytest.raises(ValueError):
        U.near_duplicate_groups(df, RECORD, anchors=["nope"])


def test_hot_block_is_counted_whole(spark, one):
    """One key holds most rows; nothing is capped."""
    df = spark.range(20000).select(
        F.when(F.col("id") < 15000, "hot").otherwise(F.col("id").cast("string")).alias("name"),
        F.col("id").cast("string").alias("country"), F.lit("1").alias("tier"),
    )
    expected = {"n_groups": 1, "n_records": 15000}
    assert one(U.near_duplicate_count(df, RECORD, anchors=["name"])) == expected
    assert one(U.near_duplicate_count_wide(df, RECORD, anchors=["name"])) == expected


# --- conformance -------------------------------------------------------------------
@pytest.mark.parametrize("text, number", [
    ("$12.50", 12.5), ("12.50", 12.5), (" 12.5 ", 12.5), ("-", None), ("--", None), ("N/A", None), ("", None),
    (None, None), ("1.5d", None), ("1_000", None), ("1,5", None), ("1e3", 1000.0), ("$-3", -3.0), (".5", 0.5),
    ("5.", 5.0), ("#ERR", None), ("TBD", None),
])
def test_parsed_number(spark, one, text, number):
    df = spark.createDataFrame([(text,)], "c string")
    got = one(df.select(
        C.parsed_number("c").alias("n"), C.unparseable("c").alias("bad"), C.unparseable("c", False).alias("strict"),
        C.number_needs_cleaning("c").alias("dirty"),
    ))
    assert got == {
        "n": number, "bad": number is None, "strict": number is None and text is not None,
        "dirty": number is not None and "$" in text,
    }


def test_nan_text_is_a_number(spark, one):
    df = spark.createDataFrame([("NaN",)], "c string")
    assert one(df.select(C.unparseable("c").alias("bad"))) == {"bad": False}


@pytest.mark.parametrize("text, needs_reformat, day", [
    ("Jan 05 2023", True, datetime.date(2023, 1, 5)), ("Jan 5 2023", True, datetime.date(2023, 1, 5)),
    ("2023-01-05", False, None), ("2024-13-01", False, None), (None, False, None), ("text", False, None),
    ("Feb 30 2023", False, None),
])
def test_text_dates(spark, one, text, needs_reformat, day):
    df = spark.createDataFrame([(text,)], "c string")
    assert one(df.select(C.date_needs_reformat("c").alias("r"), C.text_date("c").alias("d"))) == {
        "r": needs_reformat, "d": day,
    }


def test_range_bounds_pass(spark, one):
    df = spark.createDataFrame([(-1,), (0,), (None,), (10,), (11,)], "c long")
    assert one(V.range_violations(df, "c", 0, 10)) == {"n_out_of_range": 2}
    assert one(V.range_violations(df, "c", 0)) == {"n_out_of_range": 1}
    assert one(V.range_violations(df, "c")) == {"n_out_of_range": 0}


def test_examples_are_the_smallest_offender(spark, rows):
    df = spark.createDataFrame([("N/A",), ("#ERR",), ("$2",), ("3",)], "c string")
    got = V.violation_examples(df, "c", {"unparseable": C.unparseable("c"), "type": C.number_needs_cleaning("c")})
    assert rows(got) == [("type", 1, "$2"), ("unparseable", 2, "#ERR")]


# --- the fused suite -----------------------------------------------------------------
def test_suite_is_one_scan_and_drops_repeats(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([("$1", -1, "Jan 05 2023")], "a string, q long, d string").write.parquet(path)
    checks = [suite.number_type("a"), suite.iso_format("d"), suite.not_negative("q"), suite.parseable("a"),
              suite.parseable("a")]
    found = suite.run_checks(spark.read.parquet(path), "t", checks)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    assert found.columns == list(FINDING_COLUMNS)
    assert [(r.issue_type, r.n_bad, r.example) for r in found.collect()] == [
        ("type_violation", 1, "$1"), ("date_format_violation", 1, "Jan 05 2023"), ("negative_value", 1, "-1"),
        ("unparseable", 0, None),
    ]


def test_failing_rows_and_passes(spark, rows):
    df = spark.createDataFrame([(1, "x", 5), (2, None, -1), (3, "y", -2)], "id long, c string, q long")
    checks = [suite.null("c"), suite.not_negative("q")]
    assert rows(suite.failing_rows(df, checks).select("id", F.array_join("failed", ";"))) == [
        (2, "null:c;not_negative:q"), (3, "not_negative:q"),
    ]
    assert rows(df.where(suite.passes(checks)).select("id")) == [(1,)]
