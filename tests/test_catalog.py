import contextlib
import math

import pytest
from pyspark.sql import functions as F

from plumbline.sources import catalog as S, sinks, sqlguard


def test_pandas_nan_becomes_null(spark, one):
    import pandas as pd

    frame = pd.DataFrame({"id": [1.0, None, 3.0], "name": ["a", "b", None]})
    df = S.from_pandas(spark, frame)
    assert one(df.agg(F.count_if(F.col("id").isNull()).alias("n"))) == {"n": 1}
    assert not any(r.id is not None and math.isnan(r.id) for r in df.collect())


@pytest.mark.parametrize("text", [
    "DROP TABLE t", "select 1; delete from t", "  UPDATE t SET a = 1", "with x as (select 1) insert into t select 1",
    "create view v as select 1", "COPY t TO 'x'", "ATTACH 'x'", "explain select 1", "", None, "TRUNCATE TABLE t", "ALTER TABLE t ADD COLUMN a INT",
    "FROM t INSERT INTO u SELECT *", "EXECUTE IMMEDIATE 'DROP TABLE t'", "SET spark.x = 1", "CACHE TABLE t", "SHOW TABLES", "BEGIN SELECT 1; END",
    "SELECT transform(a) USING 'cat' AS (b) FROM t", "SELECT * FROM t VERSION AS OF 1", "MERGE INTO t USING u ON true WHEN MATCHED THEN DELETE",
    "SELECT * FROM IDENTIFIER('se' || 'cret')", "SELECT IDENTIFIER('reflect')('a', 'b')", "SELECT * FROM python_function(1)", ";",
])
def test_refused_statements(spark, text):
    with pytest.raises(S.RefusedStatement):
        S.guard(spark, text)


@pytest.mark.parametrize("text", [
    "SELECT last_update, created FROM t", "  with a as (select 1) select * from a", "select dropped from copies", "TABLE t",
    "SELECT 'update', \"drop\" -- delete from t\n FROM t WHERE note = 'insert; select' /* alter */", "SELECT `update` FROM t", "FROM t |> WHERE a = 1",
])
def test_allowed_statements(spark, text):
    assert S.guard(spark, text) == text.strip()


@pytest.mark.parametrize(("text", "tables"), [
    ("SELECT * FROM (SELECT 1) x, secret", {"secret"}), ("WITH t AS (TABLE secret) SELECT * FROM t", {"secret"}),
    ("SELECT EXTRACT(year FROM d), 'from x' FROM a CROSS JOIN b AS c -- from d\n LEFT JOIN e ON a.k IS DISTINCT FROM e.k", {"a", "b", "e"}),
    ("WITH t (x) AS (SELECT 1), u AS (SELECT * FROM v) SELECT * FROM t, u", {"v"}),
    ("WITH x AS (SELECT * FROM later), later AS (SELECT 1) SELECT * FROM x, later", {"later"}),
    ("WITH a AS (SELECT * FROM a) SELECT * FROM a", {"a"}), ("WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT * FROM r", set()),
    ("SELECT * FROM p WHERE k IN (SELECT k FROM q) AND EXISTS (WITH w AS (SELECT 1) SELECT * FROM r, w) HAVING 1 > (SELECT max(n) FROM s)", {"p", "q", "r", "s"}),
    ("SELECT * FROM l JOIN LATERAL (SELECT * FROM m WHERE m.k = l.k) ON true LATERAL VIEW explode(array(1)) e AS z", {"l", "m"}),
    ("SELECT CASE WHEN (SELECT count(*) FROM deep) > 0 THEN 1 END FROM range(3) UNION SELECT a FROM VALUES (1) AS v (a) EXCEPT TABLE gone", {"deep", "gone"}),
    ("WITH a AS (WITH b AS (SELECT * FROM c) SELECT * FROM b) SELECT * FROM a, b", {"b", "c"}), ("SELECT sum(n) OVER w FROM t WINDOW w AS (PARTITION BY (SELECT max(k) FROM u))", {"t", "u"}),
])
def test_tables_a_query_reads(spark, text, tables):
    assert {".".join(n) for n in sqlguard.reads(spark, text)[0]} == tables
    with pytest.raises(S.RefusedStatement) if tables else contextlib.nullcontext():
        S.guard(spark, text, ["other"])
    assert S.guard(spark, text, [t.upper() for t in tables]) == text


def test_run_sql_returns_the_whole_result(spark):
    S.register(spark, {"numbers": spark.range(500).toDF("n")})
    assert S.run_sql(spark, "SELECT n FROM numbers;").count() == 500
    assert S.run_sql(spark, "WITH a AS (SELECT n FROM numbers), b AS (SELECT * FROM a) SELECT * FROM a JOIN b USING (n)", ["numbers"]).count() == 500


@pytest.mark.parametrize("text", [
    "SELECT * FROM parquet.`/root/testdata/sf0.001/region.parquet`",
    "SELECT (SELECT count(*) FROM json . `/tmp/x`) AS n",
    "SELECT reflect('java.lang.System', 'getProperty', 'user.home')",
    "SELECT try_reflect ('java.lang.System', 'exit', 1)", "SELECT java_method('a', 'b')",
    "SELECT * FROM other", "SELECT * FROM (SELECT 1) x, other", "WITH t AS (TABLE other) SELECT * FROM t", "SELECT * FROM numbers, other o", "SELECT * FROM numbers n JOIN other ON true",
    "SELECT n FROM numbers WHERE n IN (SELECT n FROM global_temp.other)",
])
def test_reads_of_anything_else_are_refused(spark, text):
    with pytest.raises(S.RefusedStatement):
        S.run_sql(spark, text, ["numbers"])


def test_preview_is_ordered(spark):
    got = [r.n for r in S.preview(spark.range(500).toDF("n"), [F.desc("n")], 3).collect()]
    assert got == [499, 498, 497]


def test_observe(spark, rows):
    tables = {"a": spark.range(3).toDF("x"), "b": spark.createDataFrame([], "y string, z double")}
    assert rows(S.observe(tables)) == [
        ("a", "x", "bigint", 3), ("b", "y", "string", 0), ("b", "z", "double", 0),
    ]


def test_findings_and_runs_round_trip(spark, tmp_path, rows):
    df = spark.createDataFrame([("c", 1, 0.5)], "check string, n_bad long, rate double")
    for fmt in ("parquet", "json"):
        path = str(tmp_path / fmt)
        sinks.write_findings(df, path, fmt)
        assert rows(spark.read.format(fmt).load(path).select("check", "n_bad", "rate")) == [("c", 1, 0.5)]
    runs = spark.createDataFrame(
        [(1, 42, 0.7, ["q1", "q2"], {"null_email": "3"})], sinks.RUN_SCHEMA
    )
    sinks.write_runs(runs, str(tmp_path / "runs"))
    sinks.write_runs(runs, str(tmp_path / "runs"))
    back = sinks.read_runs(spark, str(tmp_path / "runs"))
    assert back.count() == 2 and back.first().query_plan == ["q1", "q2"]


def test_workers_import_the_package_wherever_they_start(spark):
    from plumbline.session import ship_package

    assert ship_package(spark) is ship_package(spark)  # sent once, by build_session
    (name,) = [f for f in spark.sparkContext._jsc.sc().listFiles().mkString("|").split("|") if f.endswith("plumbline.zip")]
    def where(batches):
        import os
        os.chdir("/")
        for batch in batches:
            from plumbline.functions import vocabulary
            batch["id"] = len(vocabulary.__name__)
            yield batch

    assert {r.id for r in spark.range(8).mapInPandas(where, "id bigint").collect()} == {len("plumbline.functions.vocabulary")}
