"""Write-back, stored profiles, narrowed percentiles and bucketed tables."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import baseline as B, relational as R
from plumbline.operators.narrowing import percentiles_by_narrowing
from plumbline.sources import bucketed, writeback as W


def _files(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*.parquet")}


@pytest.fixture
def stock(spark, tmp_path):
    folder = tmp_path / "stock"
    data = [(1, -5, "007"), (2, 6, "007"), (3, 7, "7"), (4, -8, None), (5, None, None), (6, -1, "a b/c=d")]
    spark.createDataFrame(data, "id int, q int, shop string").write.partitionBy("shop").parquet(str(folder))
    return folder


def test_only_touched_partitions_are_written(spark, stock, rows):
    before = _files(stock)
    assert W.update_in_place(spark, str(stock), ["shop"], {"q": "abs(q)"}, "q < 0") == 3
    assert rows(W.open_table(spark, str(stock), ["shop"])) == sorted(
        [(1, 5, "007"), (2, 6, "007"), (3, 7, "7"), (4, 8, None), (5, None, None), (6, 1, "a b/c=d")], key=str
    )
    after = _files(stock)
    assert {f for f in before if after.get(f) == before[f]} == {f for f in before if f.startswith("shop=7/")}
    assert W.update_in_place(spark, str(stock), ["shop"], {"q": "abs(q)"}, "q < 0") == 0 and _files(stock) == after
    assert W.update_in_place(spark, str(stock), ["shop"], {"q": "q + 1"}, F.col("shop") == "007") == 1
    assert {r.q for r in W.open_table(spark, str(stock), ["shop"]).where("shop = '007'").collect()} == {6, 7}


def test_a_failed_update_leaves_the_table(spark, stock):
    before = _files(stock)
    with pytest.raises(Exception, match="lost"):
        W.update_in_place(spark, str(stock), ["shop"], {"q": F.when(F.col("id") == 4, F.raise_error(F.lit("lost")).cast("int")).otherwise(0)}, "q < 0")
    assert _files(stock) == before
    for assignments, by in (({"shop": "'x'"}, ["shop"]), ({"q": "0"}, ["none"]), ({"none": "0"}, ["shop"])):
        with pytest.raises(ValueError):
            W.update_in_place(spark, str(stock), by, assignments, "true")


def test_profiles_of_parts_merge(spark, tmp_path, rows):
    made = random.Random(5)
    data = [(made.gauss(1e6, 3), made.randrange(7)) for _ in range(20_000)] + [(float("nan"), 8), (None, 8), (4.0, None)]
    df = spark.createDataFrame(data, "v double, part int")
    folder = str(tmp_path / "profiles")
    for _ in range(2):  # the second replaces the first
        B.store(B.profile(df, ["v", "part"], ["part"]), folder, "a")
    B.store(B.profile(df.where("part < 3"), ["v"]), folder, "b")
    found = {r["column_name"]: r for r in B.stored(spark, folder, "a").collect()}
    v = [x for x, _ in data if x is not None and x == x]
    assert found["v"]["n_rows"] == len(data) and found["v"]["n_values"] == len(v)
    assert found["v"]["mean"] == pytest.approx(statistics.fmean(v)) and found["v"]["m2"] == pytest.approx(np.var(v) * len(v), rel=1e-9)
    assert (found["v"]["least"], found["v"]["most"]) == (min(v), max(v))
    assert found["part"]["n_values"] == len(data) - 1
    shift = {r["statistic"]: r for r in B.profile_shift(B.stored(spark, folder, "a"), B.stored(spark, folder, "b"), (0.05, 0.5, 0.99)).where("column_name = 'v'").collect()}
    order = np.sort(v)
    for name, q in (("p5", 0.05), ("p50", 0.5), ("p99", 0.99)):
        at = shift[name]["baseline_value"]
        assert np.searchsorted(order, at, "left") / len(v) - B.RANK_ERROR <= q <= np.searchsorted(order, at, "right") / len(v) + B.RANK_ERROR
        assert abs(shift[name]["rank_in_baseline"] - q) < 0.05
    assert shift["ignored"]["baseline_value"] == 2 and shift["stddev"]["baseline_value"] == pytest.approx(np.std(v, ddof=1))


def test_profiles_without_values(spark):
    df = spark.createDataFrame([(None, 1.0)], "v double, w double")
    for some in (df, df.limit(0)):
        shift = B.profile_shift(B.merged(B.profile(some, ["v"])), B.merged(B.profile(df, ["v", "w"])))
        told = {(r["column_name"], r["statistic"]): (r["baseline_value"], r["current_value"]) for r in shift.collect()}
        assert told["v", "p50"] == told["v", "mean"] == (None, None) and told["w", "p50"] == (None, 1.0) and told["v", "ignored"] == (some.count(), 1)


@pytest.mark.parametrize("kind", ["spread", "ties", "edges"])
def test_narrowed_percentiles(spark, kind):
    n = 60_000
    one = {
        "spread": ((F.col("id") * 7919) % n).cast("double"),
        "ties": ((F.col("id") * 7919) % 3).cast("double"),
        "edges": F.when(F.col("id") % 2 == 0, -5.0).when(F.col("id") % 501 == 0, F.col("id") / n).otherwise(F.lit(float("inf"))),
    }[kind]
    df = spark.range(n).select(one.alias("v"), (F.col("id") % 5 == 0).alias("g"))
    df = df.unionByName(spark.createDataFrame([(float("nan"), True), (None, False), (2.0, None)], "v double, g boolean"))
    wanted = [0.0, 0.25, 0.5, 0.501, 0.99, 1.0] if kind != "edges" else [0.0, 0.4, 0.75, 1.0]
    plain = [(r["g"], r["v"]) for r in df.collect() if r["v"] is not None and r["v"] == r["v"]]
    for by in (None, "g"):
        expected = {}
        for g in {g for g, _ in plain} if by else [0]:
            order = sorted(v for k, v in plain if not by or k == g)
            for q in wanted:
                at = q * (len(order) - 1)
                low, high = order[math.floor(at)], order[math.ceil(at)]
                expected[g, q] = low if low == high else low + (high - low) * (at - math.floor(at))
        got = {(r[by] if by else 0, r["quantile"]): r["value"] for r in percentiles_by_narrowing(df, "v", wanted, by, most=20).collect()}
        assert got == pytest.approx(expected)
    assert percentiles_by_narrowing(df.limit(0), "v", wanted).count() == 0


def test_checks_on_bucketed_tables_move_nothing(spark, tmp_path, one):
    made = random.Random(3)
    orders = spark.createDataFrame([(k, made.choice([made.randrange(60), None, 7]), float(k)) for k in range(500)], "o int, c int, total double")
    customers = spark.createDataFrame([(k,) for k in range(40)], "c int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for files in (1, 3):
            child, parent = (
                bucketed.write_bucketed(df, f"{name}_{files}", str(tmp_path / f"{name}_{files}"), ["c"], 8, files)
                for name, df in (("orders", orders), ("customers", customers))
            )
            found = R.orphan_count(child, "c", parent, "c")
            assert one(found) == one(R.orphan_count(orders, "c", customers, "c"))
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "hashpartitioning" not in plan and plan.count("Exchange SinglePartition") >= 1
            assert child.count() == 500 and len(_files(tmp_path / f"orders_{files}")) <= 8 * files
        sizes = {r["bucket"]: r["n_rows"] for r in bucketed.bucket_sizes(orders, ["c"], 8).collect()}
        assert sum(sizes.values()) == 500 and max(sizes.values()) >= orders.where("c = 7").count()
        with pytest.raises(Exception, match="ALREADY_EXISTS"):
            bucketed.write_bucketed(orders, "orders_1", str(tmp_path / "other"), ["c"], 8)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for files in (1, 3):
            spark.sql(f"DROP TABLE IF EXISTS orders_{files}")
            spark.sql(f"DROP TABLE IF EXISTS customers_{files}")
