"""Drift, relational checks, percentiles and the salted join on edge rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.operators import drift as D, quantiles as Q, relational as R
from plumbline.operators.spread import join_rows_with_keys
from plumbline.plans import audits as A


def _snapshot(spark, values):
    return spark.createDataFrame(values, "user_id long, category string, amount double")


# --- drift ---------------------------------------------------------------------
def test_equal_snapshots_show_no_drift(spark, one, rows):
    df = _snapshot(spark, [(1, "a", 2.0), (2, "b", 4.0)])
    assert one(D.mean_shift(df, df, "amount")) == {"baseline_mean": 3.0, "current_mean": 3.0, "delta": 0.0}
    assert rows(D.new_categories(df, df, "category")) == []
    assert one(D.novel_reference_share(df, df, "user_id")) == {"n_novel": 0, "n_rows": 2, "new_row_share": 0.0}


def test_empty_baseline(spark, one, rows):
    empty, df = _snapshot(spark, []), _snapshot(spark, [(1, "a", 2.0)])
    assert one(D.mean_shift(empty, df, "amount"))["baseline_mean"] is None
    assert rows(D.new_categories(empty, df, "category")) == [("a", 1)]
    assert one(D.novel_reference_share(empty, df, "user_id"))["new_row_share"] == 1.0
    assert one(D.novel_reference_share(df, empty, "user_id")) == {"n_novel": 0, "n_rows": 0, "new_row_share": None}


def test_null_category_and_null_reference(spark, one, rows):
    base = _snapshot(spark, [(1, "a", 1.0), (None, None, 1.0)])
    current = _snapshot(spark, [(1, None, 1.0), (None, "b", 1.0), (5, "b", 1.0), (1, "a", 1.0)])
    assert rows(D.new_categories(base, current, "category")) == [("b", 2)]
    assert one(D.novel_reference_share(base, current, "user_id")) == {
        "n_novel": 2, "n_rows": 4, "new_row_share": 0.5,
    }


def test_share_above(spark, one):
    df = _snapshot(spark, [(2999, "a", 1.0), (3000, "a", 1.0), (None, "a", 1.0), (4000, "a", 1.0)])
    assert one(D.share_above(df, "user_id", 3000)) == {"share_above": 0.5}
    assert one(D.share_above(df.where("false"), "user_id", 3000)) == {"share_above": None}


def test_group_mean_shift_keeps_one_sided_categories(spark, rows):
    base, current = _snapshot(spark, [(1, "a", 1.0), (1, "b", 2.0)]), _snapshot(spark, [(1, "b", 5.0), (1, "c", 7.0)])
    assert rows(D.group_mean_shift(base, current, "category", "amount")) == [
        ("a", 1.0, None, None), ("b", 2.0, 5.0, 3.0), ("c", None, 7.0, None),
    ]


@pytest.mark.parametrize("values", [
    [5.0], [1.0, 2.0], [float(x) for x in range(101)], [3.0] * 50 + [1.0, 9.0, None, float("nan")],
    [(x * 7919) % 1009 / 10 for x in range(3000)],
])
def test_exact_percentiles(spark, rows, values):
    import numpy as np

    qs = [0.0, 0.05, 0.5, 0.9, 1.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    clean = [v for v in values if v is not None and v == v]
    got = dict(rows(Q.exact_percentiles(df, "v", qs)))
    assert got == pytest.approx(dict(zip(qs, np.quantile(clean, qs))))


def test_approx_percentiles(spark, rows):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    assert rows(Q.approx_percentiles(df, "v", [0.5])) == [(0.5, 500.0)]


# --- relational ------------------------------------------------------------------
@pytest.fixture(scope="module")
def shop(spark):
    customers = spark.createDataFrame([(1,), (2,), (2,), (None,)], "customer_id long")
    orders = spark.createDataFrame(
        [(10, 1, 30.0, "2024-01-01", "2024-01-02"), (11, 2, 5.0, "2024-01-05", "2024-01-04 10:00:00"),
         (12, 9, 7.0, "2024-01-01", "2024-01-01"), (13, None, None, "2024-01-01", "soon"),
         (14, 9, 8.0, None, "2024-01-01")],
        "order_id long, customer_id long, total double, ordered string, shipped string",
    )
    lines = spark.createDataFrame(
        [(10, 10.0, 2), (10, 10.0, 1), (11, 5.0, 1), (11, 0.000002, 1), (13, 1.0, 1), (99, 1.0, 1), (None, 4.0, 1)],
        "order_id long, price double, quantity long",
    )
    return customers, orders, lines


def test_orphans(shop, one, rows):
    customers, orders, _ = shop
    assert one(R.orphan_count(orders, "customer_id", customers, "customer_id")) == {"orphan_count": 3}
    assert rows(R.orphan_rows(orders, "customer_id", customers, "customer_id").select("order_id")) == [
        (12,), (13,), (14,),
    ]
    found = A.orphan_finding(orders, "orders", "customer_id", customers, "customer_id").first()
    assert (found.n_bad, found.n_rows, found.rate, found.example) == (3, 5, 0.6, "9")


def test_temporal(shop, one, rows):
    _, orders, _ = shop
    assert one(R.temporal_violation_count(orders, "ordered", "shipped")) == {"temporal_count": 1}
    assert rows(R.temporal_violations(orders, "ordered", "shipped").select("order_id")) == [(11,)]


def test_totals(shop, rows, one):
    _, orders, lines = shop
    args = (orders, "order_id", "total", lines, "order_id")
    charge = F.col("price") * F.col("quantity")
    assert rows(R.aggregate_mismatches(*args, charge)) == [(11, 5.0, pytest.approx(5.000002))]
    assert rows(R.aggregate_mismatches(*args, charge, tolerance=1e-5)) == []
    assert rows(R.aggregate_mismatches(*args, charge, include_childless=True).select("order_id")) == [
        (11,), (12,), (14,),
    ]
    assert one(R.childless_count(orders, "order_id", lines, "order_id")) == {"childless_count": 2}
    assert rows(R.childless_parents(orders, "order_id", lines, "order_id").select("order_id")) == [(12,), (14,)]


def test_difference_at_the_tolerance_passes(spark, rows):
    parent = spark.createDataFrame([(1, 1.5), (2, 2.0)], "k long, total double")
    child = spark.createDataFrame([(1, 1.0), (2, 1.0)], "k long, amount double")
    assert rows(R.aggregate_mismatches(parent, "k", "total", child, "k", "amount", tolerance=0.5).select("k")) == [(2,)]


def test_repeated_parent_meets_its_lines_as_often(spark, rows):
    """As a join before the sum would do."""
    parent = spark.createDataFrame([(1, 6.0), (1, 6.0), (2, 3.0)], "k long, total double")
    child = spark.createDataFrame([(1, 3.0), (2, 3.0)], "k long, amount double")
    assert rows(R.aggregate_mismatches(parent, "k", "total", child, "k", "amount")) == []


# --- the salted join -----------------------------------------------------------------
@pytest.mark.parametrize("rows_per_task", [1, 2, 1000])
@pytest.mark.parametrize("how, expected", [
    ("left_semi", [1, 1, None]), ("left_anti", [2, 3]), ("left", [1, 1, 2, 3, None]), ("inner", [1, 1, None]),
])
def test_salted_join_matches_a_plain_one(spark, how, expected, rows_per_task):
    left = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "k long").repartition(3)
    keys = spark.createDataFrame([(1, "a", 2), (None, "b", 1), (7, "c", 0)], "k long, tag string, n_rows long")
    got = join_rows_with_keys(left, keys, ["k"], how, rows_per_task=rows_per_task)
    assert sorted((r.k for r in got.collect()), key=lambda k: (k is None, k)) == expected
    assert got.columns == (["k", "tag"] if how in ("left", "inner") else ["k"])


@pytest.mark.parametrize("shuffled", [False, True])
@pytest.mark.parametrize("rows_per_task, spread_out", [(5000, True), (10**9, False)])
def test_salted_join_spreads_a_hot_key(spark, rows_per_task, spread_out, shuffled):
    left = spark.range(0, 40000, numPartitions=16).select(F.lit(1).alias("k"), "id")
    left = left.repartition(8, "k") if shuffled else left
    keys = spark.createDataFrame([(1, 40000)], "k int, n_rows long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = join_rows_with_keys(left, keys, ["k"], rows_per_task=rows_per_task)
        tasks = joined.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in tasks) == 40000 and (len(tasks) > 1) == spread_out


def test_salts_grow_with_the_key(spark):
    left = spark.range(0, 40000, numPartitions=4).select(F.when(F.col("id") < 30000, 1).otherwise(2).alias("k"), F.lit(0).alias("same"))
    keys = spark.createDataFrame([(1, 30000), (2, 10000)], "k int, n_rows long")
    plan = join_rows_with_keys(left, keys, ["k"], rows_per_task=5000)
    assert plan.count() == 40000


def test_orphan_rows_scan_each_table_once(spark, tmp_path):
    for name, df in (("child", spark.range(100).select((F.col("id") % 7).alias("fk"), "id")), ("parent", spark.range(5).toDF("pk"))):
        df.write.parquet(str(tmp_path / name))
    child, parent = (spark.read.parquet(str(tmp_path / n)) for n in ("child", "parent"))
    for made in (R.orphan_rows(child, "fk", parent, "pk"), R.orphan_count(child, "fk", parent, "pk")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 2
    assert R.orphan_rows(child, "fk", parent, "pk").count() == 28
    assert R.orphan_count(child, "fk", parent, "pk").first()[0] == 28


def test_childless_rows_take_one_scan_of_each_and_split_a_hot_parent(spark, tmp_path):
    spark.range(0, 60_000, 1, 8).selectExpr("IF(id % 3 = 0, -1L, id) AS k", "repeat(md5(string(id)), 4) AS t").write.parquet(str(tmp_path / "parents"))
    spark.range(0, 60_000, 1, 8).selectExpr("IF(id % 2 = 0, 7L, id) AS k").write.parquet(str(tmp_path / "children"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        found = R.childless_parents(spark.read.parquet(str(tmp_path / "parents")), "k", spark.read.parquet(str(tmp_path / "children")), "k")
        assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") == 2
        keys = [r["k"] for r in found.collect()]
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in settings:
            spark.conf.unset(name)
    expected = [-1 if i % 3 == 0 else i for i in range(60_000)]
    assert sorted(keys) == sorted(k for k in expected if not (k % 2 == 1 and k > 0 or k == 7))
