"""Drift verdicts, and findings turned into reports that are graded."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import vocabulary as V
from plumbline.operators import drift as D, evaluate as E, inject as I, profile, quantiles, repair, reports
from plumbline.plans import audits as A, report as P
from plumbline.plans.findings import FINDING_COLUMNS


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x double")


@pytest.mark.parametrize("before, after, n_bad, text", [
    ((1.0, 2.0, 3.0), (3.0, 1.0, 2.0), 0, "mean shift from 2.00 to 2.00"),
    ((0.1, 0.2, 0.3), (0.3, 0.2, 0.1), 0, "mean shift from 0.20 to 0.20"),
    ((1.0, 3.0), (2.0, 2.05), 0, "mean shift from 2.00 to 2.03"), ((1.0, 3.0), (2.0, 2.3), 2, "mean shift from 2.00 to 2.15"),
    ((1.0,), (None, None), 2, "mean shift from 1.00 to none"), ((None,), (1.0,), 1, "mean shift from none to 1.00"),
    ((None,), (None,), 0, "mean shift from none to none"), ((0.0,), (0.1,), 1, "mean shift from 0.00 to 0.10"),
])
def test_mean_shift_verdict(spark, one, before, after, n_bad, text):
    got = one(A.mean_shift_finding(numbers(spark, *before), numbers(spark, *after), "t", "x"))
    assert (got["n_bad"], got["example"]) == (n_bad, text)


def test_distribution_verdict(spark, one):
    base = spark.range(1000).select((F.col("id") % 100).cast("double").alias("x"))
    wide = base.select((F.col("x") * 1.5 - 25).alias("x"))
    assert one(A.distribution_finding(base, base.orderBy(F.rand(1)), "t", "x"))["n_bad"] == 0
    got = one(A.distribution_finding(base, wide, "t", "x"))
    assert got["n_bad"] == 1000 and got["example"] == "moved: p25, p75, stddev"
    assert one(A.distribution_finding(base, base.select(F.lit(None).cast("double").alias("x")), "t", "x"))["n_bad"] == 1000


def test_one_rule_for_nan(spark):
    base = numbers(spark, 1.0, 2.0, 3.0, float("nan"), None)
    got = {r.statistic: r.baseline_value for r in D.distribution_shift(base, base, "x").collect()}
    assert got == {"stddev": 1.0, "p25": 1.5, "p50": 2.0, "p75": 2.5, "ignored": 2.0}


@pytest.mark.parametrize("accuracy", [20_000, 50])
def test_exact_percentiles_against_sorting(spark, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    import random

    rng = random.Random(4)
    data = [(g, float(rng.choice([rng.randint(0, 9), rng.random() * 100]))) for g in (True, False) for _ in range(700 if g else 333)]
    df = spark.createDataFrame(data, "g boolean, x double")
    wanted = (0.0, 0.01, 0.25, 0.5, 0.999, 1.0)
    got = {(r.g, r.quantile): r.value for r in quantiles.exact_percentiles(df, "x", wanted, by="g").collect()}
    for g in (True, False):
        own = sorted(x for h, x in data if h == g)
        for q in wanted:
            at = q * (len(own) - 1)
            low, high = own[int(at)], own[min(int(at) + 1, len(own) - 1)]
            assert got[(g, q)] == pytest.approx(low + (high - low) * (at - int(at)))


def test_percentiles_run_nothing_before_an_action(spark):
    before = spark.sparkContext.statusTracker().getJobIdsForGroup()
    D.distribution_shift(numbers(spark, 1.0), numbers(spark, 2.0), "x")
    assert spark.sparkContext.statusTracker().getJobIdsForGroup() == before


def test_exact_sums_and_extremes(spark, rows):
    df = spark.createDataFrame([(9007199254740993,), (9007199254740995,)], "n long").withColumn("d", F.lit("0.10").cast("decimal(20,2)")).withColumn("x", F.lit(0.5))
    got = {r.column_name: (r.exact_sum, r.exact_min, r.exact_max) for r in profile.column_summary(df, ["n", "d", "x"]).collect()}
    assert got == {"n": ("18014398509481988", "9007199254740993", "9007199254740995"), "d": ("0.20", "0.10", "0.10"), "x": (None, None, None)}


def test_dedupe_keeps_maps(spark):
    df = spark.createDataFrame([(1, 2, {"a": 1}), (1, 1, {"b": 2}), (2, 5, None)], "k int, o int, m map<string,int>")
    got = sorted((r.k, r.o, r.m) for r in repair.drop_duplicates(df, ["k"], ["o"]).collect())
    assert got == [(1, 1, {"b": 2}), (2, 5, None)]
    assert len(repair.drop_duplicates(df.unionByName(df), ["k", "o"]).collect()) == 3
    with pytest.raises(ValueError):
        repair.drop_duplicates(df, ["m"])


def test_variants_in_one_scan(spark, tmp_path):
    spark.range(20).select("id", (F.col("id") * 10).alias("v")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    made = I.append_near_copies(I.append_copies(df, I.pick_rows("id", 10, 1)), I.pick_rows("id", 5, 2), "v", F.col("v") + 1)
    assert made._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert made.count() == 20 + 2 + 4 and made.where("v = id * 10 + 1").count() == 4
    assert I.append_near_copies(df, F.lit(True), "v", F.col("v")).count() == 20


# --- reports ------------------------------------------------------------------------
def findings(spark, *rows):
    made = [("c", "t", column, issue, bad, 100, bad / 100, example, V.CONFIDENCE[issue]) for column, issue, bad, example in rows]
    return spark.createDataFrame(made, ", ".join(f"`{c}` {k}" for c, k in zip(
        FINDING_COLUMNS, ("string", "string", "string", "string", "long", "long", "double", "string", "double"))))


ALL_KINDS = (
    ("email", "missing", 12, "N/A"), ("email", "null", 8, None), ("id", "null", 3, None), ("id", "disguised_null", 2, "-"), ("a,b", "exact_duplicate", 5, None),
    ("a,b", "near_duplicate_pattern", 4, "2 groups"), ("amount", "type_violation", 90, "$1"), ("quantity", "negative_value", 0, None),
    ("amount", "mean_shift", 100, "mean shift from 1.00 to 2.00"), ("amount", "distribution_shift", 100, "moved: p50"), ("kind", "new_category", 2, "NFT"),
    ("kind", "new_category", 1, "crypto"), ("user", "referential_drift", 0, "0.0%"), ("customer_id", "orphaned_fk", 6, "9001"),
)


def test_report_states_what_was_found(spark):
    found = findings(spark, *ALL_KINDS).withColumn("run", F.lit(1))
    rows = P.report_rows(found, ["run"])
    (row,) = P.report_json(rows, ["run"]).collect()
    report = json.loads(row.report)
    assert report["null_issues"] == {"email": {"value": 12, "confidence": 0.9}, "id": {"value": 5, "confidence": 0.9}}
    assert report["duplicate_row_count"] == {"value": 5, "confidence": 0.88}
    assert [v["issue_type"] for v in report["schema_violations"]] == ["near_duplicate_pattern", "type_violation"]
    assert report["drifted_columns"] == ["amount", "kind"]
    assert report["drift_details"]["amount"]["value"] == "mean shift from 1.00 to 2.00; moved: p50"
    assert report["drift_details"]["kind"] == {"value": "NFT,crypto", "confidence": 0.85}
    assert [(v["issue_type"], v["count"]) for v in report["relational_issues"]] == [("orphaned_fk", 6)]
    assert report["recommended_fixes"] == ["currency_to_decimal", "disguised_to_null", "drop_duplicates", "quarantine"]
    assert all(hasattr(repair, fix) for fix in V.FIXES.values())


def test_report_text_parses_back_to_its_rows(spark):
    rows = P.report_rows(findings(spark, *ALL_KINDS).withColumn("run", F.lit(1)), ["run"])
    back = reports.parse_reports(P.report_json(rows, ["run"]), ["run"])
    key = lambda r: (r.section, r.seq, r.field, r.issue_type, r.value, r.confidence)
    stated = [key(r) for r in rows.collect()]
    assert sorted(stated, key=str) == sorted((key(r) for r in back.collect()), key=str)


def test_good_report_beats_bad(spark):
    truth = spark.createDataFrame([(1, 12, 5, 5), (2, 12, 5, 5)], "run int, null_text long, null_key long, exact_duplicates long")
    good = findings(spark, *ALL_KINDS).withColumn("run", F.lit(1))
    bad = findings(spark, ("email", "missing", 40, None), ("a,b", "exact_duplicate", 1, None)).withColumn("run", F.lit(2))
    rows = P.report_rows(good.unionByName(bad), ["run"])
    got = {r.run: r.total for r in E.grade_nulls_duplicates(rows, truth, "run", text_field="email", key_field="id").collect()}
    assert got[1] > 0.9 and got[2] < 0.4


def test_empty_findings_and_full_audit(spark):
    assert P.report_rows(findings(spark), ()).count() == 0
    df = spark.createDataFrame([("a", "N/A"), (None, "x")], "k string, v string")
    found = A.full_audit(nulls_duplicates=[{"df": df, "table_name": "t", "missing": ["v"], "nulls": ["k"], "records": ["k", "v"]}],
                         conformance=[{"df": df, "table_name": "t", "amounts": ["v"]}])
    assert {(r.check, r.n_bad) for r in found.collect()} >= {("missing", 1), ("null", 1), ("parseable", 2)}
    with pytest.raises(ValueError):
        A.full_audit()
