"""Repairs, injected faults, recall and round trips."""

import decimal

import pytest
from pyspark.sql import functions as F

from plumbline.functions import columns as C
from plumbline.operators import duplicates as U, inject as I, repair as X
from plumbline.plans import audits as A, suite


@pytest.fixture(scope="module")
def orders(spark):
    return spark.range(1, 301).select(
        F.col("id").alias("order_id"),
        (F.col("id") % 20 + 1).cast("long").alias("quantity"),
        (F.col("id") * 1.25).alias("amount"),
        F.concat(F.lit("user"), F.col("id").cast("string")).alias("email"),
        F.date_add(F.lit("2023-01-01").cast("date"), F.col("id").cast("int")).cast("timestamp_ntz").alias("ordered"),
    )


def test_update_reads_old_values_and_skips_null_conditions(spark, rows):
    df = spark.createDataFrame([(1, 2), (3, None), (-1, 5)], "a long, b long")
    assert rows(X.update(df, {"a": "b", "b": "a"}, "b > 1")) == [(2, 1), (3, None), (5, -1)]
    assert rows(X.update(df, {"a": F.lit(0)}, "b > 100")) == rows(df)
    with pytest.raises(ValueError):
        X.update(df, {"nope": "1"}, "true")


def test_currency_and_dates(spark, rows):
    df = spark.createDataFrame(
        [("$12.5", "Jan 05 2023"), ("N/A", "2023-01-06"), (None, "x"), ("NaN", "Jan 7 2023")], "a string, d string"
    )
    fixed = X.dates_to_iso(X.currency_to_decimal(df, "a"), "d")
    assert dict(fixed.dtypes) == {"a": "decimal(18,2)", "d": "date"}
    assert rows(fixed.select("a", F.col("d").cast("string"))) == [
        (decimal.Decimal("12.50"), "2023-01-05"), (None, "2023-01-06"), (None, "2023-01-07"), (None, None),
    ]


def test_drop_duplicates_is_deterministic(spark, rows):
    values = [(1, 5, "b"), (1, 5, "a"), (1, 9, "z"), (None, 1, "n"), (None, 1, "n"), (2, None, "q"), (2, 1, "r")]
    for order in (values, values[::-1]):
        df = spark.createDataFrame(order, "k long, t long, v string").repartition(3)
        assert rows(X.drop_duplicates(df, ["k"], ["t"])) == [(1, 5, "a"), (2, None, "q"), (None, 1, "n")]
        assert rows(X.drop_duplicates(df, ["k"], ["t"], keep="last")) == [(1, 9, "z"), (2, 1, "r"), (None, 1, "n")]
        assert X.drop_duplicates(df, ["k", "t", "v"]).count() == 6


def test_quarantine_loses_no_row(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,)], "q long")
    clean, rejected = X.quarantine(df, F.col("q") < 0)
    assert sorted(r.q or 0 for r in clean.collect()) == [0, 1] and [r.q for r in rejected.collect()] == [-1]


# --- recall: k injected faults, k findings -----------------------------------------
def _n_bad(df, check):
    return suite.run_checks(df, "t", [check]).first().n_bad


def test_recall_of_row_checks(orders):
    pick = I.pick_rows("order_id", 7, 3)
    k = I.truth(orders, pick).first()[0]
    assert k == 43
    text = I.as_currency_text(orders, "amount")
    assert _n_bad(I.null_out(orders, "email", pick), suite.null("email")) == k
    assert _n_bad(I.disguise(orders, "email", pick, "order_id"), suite.disguised_null("email")) == k
    assert _n_bad(I.negate(orders, "quantity", pick), suite.not_negative("quantity")) == k
    assert _n_bad(I.spoil_numbers(text, "amount", pick, "order_id"), suite.parseable("amount")) == k
    assert _n_bad(text, suite.number_type("amount")) == 300
    assert _n_bad(I.as_text_date(orders, "ordered"), suite.iso_format("ordered")) == 300
    late = I.end_before_start(orders.withColumn("shipped", F.col("ordered")), "ordered", "shipped", pick, 2)
    assert _n_bad(late, suite.ordered("ordered", "shipped")) == k


def test_recall_of_copies(orders, one):
    pick = I.pick_rows("order_id", 7, 3)
    columns = ["quantity", "amount", "email"]
    assert one(U.exact_duplicate_count(I.append_copies(orders, pick), columns)) == {"duplicate_rows": 43}
    near = I.append_near_copies(orders, pick, "quantity", F.col("quantity") + 1)
    assert one(U.near_duplicate_count(near, columns, ["email"])) == {"n_groups": 43, "n_records": 86}
    assert near.exceptAll(orders).count() == 43
    same = I.append_near_copies(orders, pick, "quantity", F.col("quantity"))
    assert same.count() == orders.count()


def test_recall_of_drift_and_relations(spark, orders, rows):
    pick = I.pick_rows("order_id", 7, 3)
    drifted = I.shift_ids(I.scale_measure(orders, "amount", 2.0), "order_id", pick, 100000)
    drifted = I.add_categories(drifted, "email", I.pick_rows("order_id", 50, 0), "order_id", ["crypto", "NFT"])
    found = A.audit_drift(orders, drifted, "orders", ["amount"], ["email"], ["order_id"]).collect()
    by_check = {(r.check, r.example if r.check == "new_category" else None): r for r in found}
    assert by_check["mean_shift", None].example == "mean shift from 188.13 to 376.25"
    assert by_check["mean_shift", None].rate == pytest.approx(1.0)
    assert {key[1] for key in by_check if key[0] == "new_category"} == {"crypto"}  # only even ids are picked
    assert by_check["novel_reference", None].n_bad == 43
    parent = orders.select("order_id")
    assert A.orphan_finding(drifted, "orders", "order_id", parent, "order_id").first().n_bad == 43
    totals = I.inflate_totals(orders, "amount", pick, 1.5)
    mismatch = A.mismatch_finding(totals, "orders", "order_id", "amount", orders, "order_id", "amount", 1e-6).first()
    assert (mismatch.n_bad, mismatch.n_rows) == (43, 300)


# --- round trips: inject, repair, check again ------------------------------------------
def test_round_trips(orders):
    pick = I.pick_rows("order_id", 7, 3)
    dirty = I.negate(I.disguise(orders, "email", pick, "order_id"), "quantity", pick)
    fixed = X.update(X.disguised_to_null(dirty, ["email"]), {"quantity": "abs(quantity)"}, "quantity < 0")
    checks = [suite.disguised_null("email"), suite.not_negative("quantity")]
    report = X.compare_findings(suite.run_checks(dirty, "t", checks), suite.run_checks(fixed, "t", checks)).collect()
    assert {(r.n_bad_before, r.n_bad_after, r.n_fixed, r.is_resolved) for r in report} == {(43, 0, 43, True)}
    assert fixed.drop("email").exceptAll(orders.drop("email")).count() == 0

    text = I.as_text_date(I.as_currency_text(orders, "amount"), "ordered")
    clean = X.dates_to_iso(X.currency_to_decimal(text, "amount"), "ordered")
    back = clean.select("order_id", F.col("amount").cast("double"), F.col("ordered").cast("timestamp_ntz"))
    rounded = orders.select("order_id", F.round("amount", 2), "ordered")
    assert back.exceptAll(rounded).count() == 0

    copies = I.append_copies(orders, pick)
    assert X.drop_duplicates(copies, ["order_id"]).exceptAll(orders).count() == 0
