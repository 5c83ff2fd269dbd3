"""Splits, row-wise verification and the store of runs."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import repair as X
from plumbline.sources import runstore


def test_split_by_verdict(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, -1, "x"), (2, 5, None), (3, None, ""), (4, -2, "")], "id int, q int, verdict string")
    checks = {"negative": "q < 0", "empty": F.col("verdict") == ""}
    clean, rejected = X.split_by_verdict(df, checks, str(tmp_path / "out"))
    assert rows(clean) == [(2, 5)] and clean.columns == ["id", "q"]
    assert rows(rejected) == [(1, -1, ["negative"]), (3, None, ["empty"]), (4, -2, ["negative", "empty"])]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        X.split_by_verdict(df, checks, str(tmp_path / "out"))
    for k, some in enumerate((df.limit(0), df.where("q > 0"))):
        clean, rejected = X.split_by_verdict(some, {"negative": "q < 0"}, str(tmp_path / f"none{k}"))
        assert (clean.count(), rejected.count()) == (k, 0)


def test_a_repair_that_breaks_as_many_rows_is_seen(spark, one):
    df = spark.createDataFrame([(-1,), (-2,), (3,), (4,), (None,), (0,)], "q int")
    told = X.verified_update(df, {"q": "-q"}, "q <> -2", {"negative": "q < 0"})
    assert one(told) == {"check": "negative", "n_rows": 6, "n_bad_before": 2, "n_bad_after": 3, "n_fixed": 1, "n_still_bad": 1, "n_newly_broken": 2}
    assert X.verified_update(df.limit(0), {"q": "-q"}, "true", {"negative": "q < 0"}).count() == 0


def _runs(spark, *found):
    return spark.createDataFrame(
        [(t, s, x, ["a"], {"n": str(s), "k": "v"}) for t, s, x in found], "task_id int, seed int, score double, query_plan array<string>, evidence map<string,string>"
    )


def test_adding_runs_twice_changes_nothing(spark, tmp_path, rows):
    folder = str(tmp_path / "runs")
    assert runstore.read(spark, folder).count() == 0
    first = _runs(spark, (1, 1, 0.5), (1, 2, 0.7), (2, 1, 0.1))
    for _ in range(2):
        runstore.add(first, folder, keep=2)
        assert rows(runstore.read(spark, folder).select("task_id", "seed", "score")) == [(1, 1, 0.5), (1, 2, 0.7), (2, 1, 0.1)]
    untouched = {p.name: p.read_bytes() for p in (tmp_path / "runs" / "task_id=2").iterdir() if p.suffix == ".parquet"}
    runstore.add(_runs(spark, (1, 3, 0.6), (1, 4, 0.6), (3, 9, -1.0)), folder, keep=2)
    assert rows(runstore.read(spark, folder).select("task_id", "seed", "score")) == [(1, 2, 0.7), (1, 3, 0.6), (2, 1, 0.1), (3, 9, -1.0)]
    assert untouched == {p.name: p.read_bytes() for p in (tmp_path / "runs" / "task_id=2").iterdir() if p.suffix == ".parquet"}
    got = runstore.read(spark, folder).where("task_id = 1 AND seed = 3").first()
    assert got.query_plan == ["a"] and got.evidence == {"n": "3", "k": "v"}


def test_a_failed_addition_leaves_the_store(spark, tmp_path, rows):
    folder = str(tmp_path / "runs")
    runstore.add(_runs(spark, (1, 1, 0.5)), folder)
    broken = _runs(spark, (1, 2, 0.9)).withColumn("score", F.raise_error(F.lit("lost")).cast("double"))
    for bad in (broken, _runs(spark, (1, 2, 0.9)).withColumn("task_id", F.lit(None).cast("int"))):
        with pytest.raises(Exception):
            runstore.add(bad, folder)
        assert rows(runstore.read(spark, folder).select("task_id", "seed", "score")) == [(1, 1, 0.5)]
