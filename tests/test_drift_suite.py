"""The fused drift pass against the single checks."""

import pytest
from pyspark.sql import functions as F

from plumbline import registry
from plumbline.plans import audits as A, drift_suite as S
from plumbline.plans.findings import all_findings, written
from tests.oracle import compare, connect

registry.load_all()
SCHEMA = "m double, n int, c string, r bigint"
ROWS = {
    "usual": [(float(i % 37), i % 11, "abc"[i % 3], i % 50) for i in range(400)],
    "moved": [(float(i % 41) * 1.3, i % 23, ("abdx"[i % 4] if i % 9 else None), i % 70 if i % 8 else None) for i in range(300)],
    "odd": [(float("nan"), None, None, None), (None, 3, "", 0), (2.5, -1, " a", 7), (2.5, -1, "a", 7)],
    "one": [(1.0, 1, "a", 1)], "none": [], "nulls": [(None, None, None, None)] * 3,
}


def _rounded(df):
    return sorted(
        (tuple(str(round(v, 9)) if isinstance(v, float) else v for v in r) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r)
    )


@pytest.mark.parametrize(("before", "after"), [
    ("usual", "moved"), ("usual", "usual"), ("usual", "odd"), ("odd", "usual"), ("none", "usual"), ("usual", "none"), ("none", "none"), ("one", "nulls"), ("nulls", "one"),
])
def test_same_findings_as_the_single_checks(spark, before, after):
    base, current = (spark.createDataFrame(ROWS[n], SCHEMA) for n in (before, after))
    for exact in (True, False):
        fused = S.audit_drift(base, current, "t", ["m", "n"], ["c", "r"], ["r", "c"], ["n", "m"], exact=exact)
        single = all_findings(
            *(A.mean_shift_finding(base, current, "t", c) for c in ("m", "n")),
            *(A.distribution_finding(base, current, "t", c, exact=exact) for c in ("n", "m")),
            *(A.new_category_findings(base, current, "t", c) for c in ("c", "r")),
            *(A.reference_drift_finding(base, current, "t", c) for c in ("r", "c")),
        )
        assert fused.columns == single.columns and _rounded(fused) == _rounded(single)


def test_percentiles_beyond_the_sketch(spark, monkeypatch):
    """Brackets that do not hold the whole group."""
    from plumbline.operators import quantiles

    monkeypatch.setattr(quantiles, "ACCURACY", 200)
    base, current = (spark.range(n).select(((F.col("id") * 7919) % n).cast("double").alias("m")) for n in (5000, 7001))
    (row,) = S.snapshot_statistics(base, current, [], ["m"], [0.0, 0.25, 0.5, 0.99, 1.0]).collect()
    assert [row[f"q_0_{k}_b"] for k in range(5)] == pytest.approx([0, 1249.75, 2499.5, 4949.01, 4999])
    assert [row[f"q_0_{k}_c"] for k in range(5)] == pytest.approx([0, 1750, 3500, 6930, 7000])


def test_three_scans_of_each_snapshot(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("base", "current")]
    for path, rows in zip(paths, ("usual", "moved")):
        spark.createDataFrame(ROWS[rows], SCHEMA).write.parquet(path)
    base, current = map(spark.read.parquet, paths)
    plan = S.audit_drift(base, current, "t", ["m", "n"], ["c", "r"], ["r"], ["n", "m"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 6


def test_written_findings_are_not_evaluated_again(spark, tmp_path):
    spark.createDataFrame(ROWS["usual"], SCHEMA).write.parquet(str(tmp_path / "t"))
    found = written(A.audit_conformance(spark.read.parquet(str(tmp_path / "t")), "t", amounts=["c"], not_negative=["n"]))
    assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 3


@pytest.mark.parametrize("name", ["audit_nulls_duplicates", "full_audit", "audit_report_rows", "audit_reports_as_json", "audit_drift", "graded_own_audit"])
def test_twins_where_clean_and_dirty_tables_differ(spark, name):
    """The smallest tables hold no near copy that tells the two apart."""
    folder = "/root/testdata/sf0.01"
    assert compare(spark, connect(folder), registry.QUERIES[name], registry.ORACLE[name], folder) is None
