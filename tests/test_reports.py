"""Reading, merging and grading reports; run history; query logs."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline.functions import scoring as S
from plumbline.operators import evaluate as E, history as H, querylog as Q, reports as R


def _parse(spark, *reports):
    values = [(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(reports)]
    return R.parse_reports(spark.createDataFrame(values, "run long, report string"), ["run"])


# --- formulas -----------------------------------------------------------------------
@pytest.mark.parametrize("reported, actual, accuracy", [
    (0, 0, 1.0), (3, 0, 0.0), (0, 10, 0.0), (103, 100, 0.8), (112, 100, 0.2), (115, 100, 0.0), (116, 100, 0.84), (150, 100, 0.5),
    (300, 100, 0.0), (94, 100, 0.6), (85, 100, 0.0), (84, 100, 0.84), (7, 7, 1.0),
])
def test_count_accuracy(spark, one, reported, actual, accuracy):
    df = spark.createDataFrame([(reported, actual)], "r long, a long")
    got = one(df.select(S.count_accuracy("r", "a").alias("s"), S.count_accuracy("r", "a", monotone=True).alias("m")))
    assert got["s"] == pytest.approx(accuracy, abs=1e-9)
    assert 0.0 <= got["m"] <= 1.0


@pytest.mark.parametrize("confidence, correct, expected", [(0.0, True, 0.7), (1.0, True, 1.0), (0.5, False, 0.925)])
def test_brier(spark, one, confidence, correct, expected):
    df = spark.createDataFrame([(confidence,)], "c double")
    assert one(df.select(S.brier(F.lit(1.0), "c", F.lit(correct)).alias("s")))["s"] == pytest.approx(expected)


@pytest.mark.parametrize("text, share", [
    ("15%", 0.15), ("15", 0.15), ("0.15", 0.15), (" 15 % of rows", 0.15), ("1", 1.0), ("Approx 15%", None),
    ("", None), (None, None), ("%", None),
])
def test_share_from_text(spark, one, text, share):
    df = spark.createDataFrame([(text,)], "t string")
    assert one(df.select(S.share_from_text("t").alias("s")))["s"] == pytest.approx(share)


@pytest.mark.parametrize("said, true, f1", [
    ("crypto, NFT", "crypto,NFT", 1.0), ("crypto", "crypto,NFT", 2 / 3), ("", "crypto", 0.0), (",, ", "", 0.0),
    ("food,food", "food", 1.0),
])
def test_set_f1(spark, one, said, true, f1):
    df = spark.createDataFrame([(said, true)], "s string, t string")
    got = one(df.select(S.set_f1(S.category_set("s"), S.category_set("t")).alias("f")))["f"]
    assert got == pytest.approx(f1, abs=1e-6)


@pytest.mark.parametrize("score, expected", [
    (None, 1e-6), (float("nan"), 1e-6), (-1.0, 1e-6), (0.0, 1e-6), (1.0, 1 - 1e-6), (2.0, 1 - 1e-6), (0.5, 0.5),
])
def test_strict(spark, one, score, expected):
    df = spark.createDataFrame([(score,)], "s double")
    assert one(df.select(S.strict(F.col("s")).alias("s")))["s"] == expected


# --- reading --------------------------------------------------------------------------
def test_mixed_shapes_lose_nothing(spark):
    rows = _parse(spark, {
        "null_issues": {"email": {"value": 3, "confidence": 0.9}, "customer_id": 5, "name": "many"},
        "duplicate_row_count": {"value": 4, "confidence": 0},
        "schema_violations": [{"column": "amount", "issue_type": "type", "count": 2}, "stray", None],
        "drift_details": [1, 2],
        "relational_issues": "none",
        "drifted_columns": ["a", "b"],
    }).collect()
    got = {(r.section, r.field, r.value, r.n_reported, r.confidence) for r in rows}
    assert got == {
        ("null_issues", "email", "3", 3, 0.9), ("null_issues", "customer_id", "5", 5, 0.5),
        ("null_issues", "name", "many", None, 0.5), ("duplicate_row_count", None, "4", 4, 0.5),
        ("schema_violations", "amount", None, 2, 0.5), ("schema_violations", None, None, 0, 0.5),
        ("drifted_columns", "a", "a", None, None), ("drifted_columns", "b", "b", None, None),
    }


@pytest.mark.parametrize("text", [None, "", "{", "[1]", "null", "{}"])
def test_unreadable_report_still_has_a_zero_count(spark, text):
    (row,) = _parse(spark, text).collect()
    assert (row.section, row.n_reported, row.confidence) == ("duplicate_row_count", 0, 0.5)


def test_merge(spark):
    first = _parse(spark, {"null_issues": {"a": {"value": 1, "confidence": 0.9}, "b": 2}, "duplicate_row_count": 9,
                           "schema_violations": [{"column": "x", "issue_type": "t"}], "drifted_columns": ["p", "q"]})
    second = _parse(spark, {"null_issues": {"a": {"value": 7, "confidence": 0.1}}, "duplicate_row_count": 4,
                            "schema_violations": [{"column": "x", "issue_type": "t"}], "drifted_columns": ["q", "r"]})
    rows = R.merge_reports(first, second, ["run"]).orderBy("section", "report", "seq").collect()
    assert [(r.section, r.field, r.n_reported) for r in rows] == [
        ("drifted_columns", "p", None), ("drifted_columns", "q", None), ("drifted_columns", "r", None),
        ("duplicate_row_count", None, 9), ("null_issues", "a", 7), ("null_issues", "b", 2),
        ("schema_violations", "x", 0), ("schema_violations", "x", 0),
    ]
    assert next(r.confidence for r in rows if r.field == "a") == 0.1


# --- grading ----------------------------------------------------------------------------
TRUTH = ("run long, null_text long, null_key long, exact_duplicates long, negative_quantity long, "
         "new_categories string, reference_share double, orphaned_count long, temporal_count long, mismatch_count long")
GOOD = {
    "null_issues": {"email": {"value": 10, "confidence": 1.0}, "customer_id": {"value": 4, "confidence": 1.0}},
    "duplicate_row_count": {"value": 12, "confidence": 1.0},
    "schema_violations": [
        {"column": "amount", "issue_type": "type_violation", "confidence": 1.0},
        {"column": "order_date", "issue_type": "date_format_violation", "confidence": 1.0},
        {"column": "quantity", "issue_type": "negative_value", "count": 6, "confidence": 1.0},
        {"column": "amount", "issue_type": "unparseable", "count": 3, "confidence": 1.0},
        {"column": "customers", "issue_type": "near_duplicate_pattern"},
    ],
    "drift_details": {"amount": {"value": "mean shift", "confidence": 1.0},
                      "category": {"value": "crypto,NFT", "confidence": 1.0},
                      "user_id": {"value": "15%", "confidence": 1.0}},
    "relational_issues": [
        {"issue_type": "orphaned_fk", "count": 18, "confidence": 1.0},
        {"issue_type": "late ship_date", "count": 11, "confidence": 1.0},
        {"issue_type": "total mismatch", "count": 7, "confidence": 1.0},
    ],
}


def test_perfect_and_empty_reports(spark):
    rows = _parse(spark, GOOD, {})
    truth = spark.createDataFrame(
        [(run, 10, 4, 12, 6, "crypto,NFT", 0.15, 18, 11, 7) for run in (0, 1, 2)], TRUTH
    )
    # run 2 has no report at all
    expected = {
        E.grade_nulls_duplicates: 0.30 + 0.25 + 0.30 + 0.15 * 0.5,
        E.grade_conformance: 0.75 + 0.25 * 0.8 * (1 - 0.3 * 0.25),
        E.grade_drift: 1.0,
        E.grade_relational: 1.0,
    }
    for grade, best in expected.items():
        got = {r.run: r.asDict() for r in grade(rows, truth, "run").collect()}
        assert got[0]["total"] == pytest.approx(best, abs=1e-4)
        assert all(0.0 < v < 1.0 for run in got.values() for k, v in run.items() if k != "run")
        assert got[1]["total"] < 0.01 and got[2]["total"] < 0.01


def test_first_statement_and_first_word_win(spark, one):
    report = {"relational_issues": [
        {"issue_type": "foreign_key", "count": 100, "confidence": 1.0},
        {"issue_type": "orphan later", "count": 18, "confidence": 1.0},
        {"issue_type": "orphan last", "count": 1, "confidence": 1.0},
    ]}
    truth = spark.createDataFrame([(0, 1, 1, 1, 1, "", 0.1, 18, 11, 7)], TRUTH)
    got = one(E.grade_relational(_parse(spark, report), truth, "run"))
    assert got["orphans"] == pytest.approx(1 - 1e-6)


def test_category_only_mentioned(spark, one):
    report = {"drift_details": {"amount": {"value": "stable", "confidence": 0.5}},
              "recommended_fixes": ["watch the Categories"]}
    truth = spark.createDataFrame([(0, 1, 1, 1, 1, "crypto", 0.1, 18, 11, 7)], TRUTH)
    got = one(E.grade_drift(_parse(spark, report), truth, "run"))
    assert (got["new_cats"], got["mean_shift"], got["ref_drift"]) == (0.3, 1e-6, 1e-6)


def test_regressions(spark, rows):
    def summary(values):
        return E.summarise_runs(spark.createDataFrame(values, "task string, total double"), "task")

    before = summary([("a", 0.9), ("a", 0.7), ("b", 0.5)])
    after = summary([("a", 0.71), ("b", 0.45), ("c", 0.1)])
    flagged = E.flag_regressions(after, before, "task").select("task", "is_regression")
    assert rows(flagged) == [("a", True), ("b", False), ("c", False)]


# --- history ------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def runs(spark):
    values = [(1, s, 0.5, ["a", "b"]) for s in range(10)] + [(1, 99, 0.9, list("vwxyz") + ["late"]), (2, 1, -0.5, ["a"])]
    return spark.createDataFrame(values, "task_id int, seed int, score double, query_plan array<string>")


def test_top_runs_break_ties_by_seed(runs, rows):
    assert rows(H.top_runs(runs, 3).select("task_id", "seed", "run_rank")) == [(1, 0, 2), (1, 1, 3), (1, 99, 1), (2, 1, 1)]
    plan = H.top_runs(runs, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # once before the shuffle


def test_check_weights(spark, runs, rows):
    asked = spark.createDataFrame([(1, "v"), (1, "z"), (1, "late"), (1, "never"), (2, "a"), (1, "b")], "task_id int, query string")
    got = {(t, q): w for t, q, w in rows(H.check_weights(runs, 3, asked))}
    assert got == pytest.approx({
        (1, "v"): 0.08 * 0.9, (1, "z"): 0.0, (1, "late"): 0.0, (1, "never"): 0.0, (2, "a"): 0.0, (1, "b"): 2 * 0.06 * 0.5,
    })


def test_keep_best(runs):
    assert [(r.task_id, r.score) for r in H.keep_best_runs(runs, 2, per_task=False).collect()] == [(2, -0.5), (1, 0.9)]
    assert {r.task_id for r in H.keep_best_runs(runs, 1).collect()} == {1, 2}


def test_no_task_is_emptied(spark):
    many = spark.range(2000).select((F.col("id") % 4).cast("int").alias("task_id"), F.col("id").alias("seed"), (F.col("id") / 2000).alias("score"))
    kept = {r.task_id: r["count"] for r in H.keep_best_runs(many, 300).groupBy("task_id").count().collect()}
    assert kept == {0: 300, 1: 300, 2: 300, 3: 300}


# --- query log ------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def log(spark):
    texts = [
        "SELECT a FROM t;", "  select  A\n from T ", "WITH x AS (SELECT 1) SELECT * FROM x JOIN db.Sales s ON true",
        "DELETE FROM t", "select last_update from t", "", None, "update t set a = 1", "EXPLAIN SELECT 1",
    ]
    return spark.createDataFrame(list(enumerate(texts)), "id long, query string")


def test_statement_flags(log, rows):
    flags = {r[0]: r[1:] for r in rows(Q.flag_statements(log).select("id", "is_read_only", "is_destructive"))}
    assert flags[0] == (True, False) and flags[3] == (False, True) and flags[4] == (True, False)
    assert flags[7] == (False, True) and flags[8] == (False, False) and flags[6] == (None, None)


def test_distinct_queries(log, rows):
    assert rows(Q.distinct_queries(log, "id").select("first_query", "first_seen", "n_uses"))[:2] == [
        ("SELECT a FROM t", 0, 2), ("WITH x AS (SELECT 1) SELECT * FROM x JOIN db.Sales s ON true", 2, 1),
    ]


def test_repeat_ratio(log, one):
    got = one(Q.repeat_ratio(log))
    assert (got["n_queries"], got["n_distinct"], got["is_excessive"]) == (9, 7, True)
    assert one(Q.repeat_ratio(log.where("false"))) == {
        "n_queries": 0, "n_distinct": 0, "repeat_ratio": 0.0, "is_excessive": False,
    }


def test_tables(log, rows):
    named = {r.id: r.tables for r in Q.with_referenced_tables(log).collect()}
    assert named[2] == ["sales", "x"] and named[8] == [] and named[6] is None
    assert rows(Q.unknown_tables(log, ["T", "x"]).select("id", "unknown_table")) == [(2, "sales")]


def test_features(log):
    row = Q.with_features(log).where("id = 4").first()
    assert (row.coverage, row.risk, row.has_limit) == (False, True, False)
