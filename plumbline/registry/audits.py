"""The four audits and all of them together."""

from pyspark.sql import DataFrame, functions as F

from ..plans import audits as A, suite
from ..plans.findings import all_findings
from ..sources.catalog import table
from . import query
from .conformance import NEEDS_CLEANING, NEEDS_REFORMAT, NOT_NUMBER
from .dirty import (
    CUSTOMERS_WITH_NULLS, DIRTY_CUSTOMERS, ORDERS_AS_TEXT, ORDERS_WITH_ORPHANS, RECORD, SNAPSHOTS, TOKENS_SQL,
    customers_with_nulls, dirty_customers, orders_as_text, orders_with_orphans, snapshots,
)
from .duplicates import NEAR_OF_CUSTOMERS, _excess


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("rate", F.round("rate", 9))


def _finding(check, table_name, column, issue, bad, example, confidence, source, rows="COUNT(*)", rate=None):
    rate = rate or f"CASE WHEN n_rows > 0 THEN CAST(n_bad AS DOUBLE) / n_rows ELSE 0.0 END"
    return f"""SELECT '{check}' AS "check", '{table_name}' AS table_name, '{column}' AS column_name,
  '{issue}' AS issue_type, CAST(n_bad AS BIGINT) AS n_bad, CAST(n_rows AS BIGINT) AS n_rows,
  ROUND({rate}, 9) AS rate, example, CAST({confidence} AS DOUBLE) AS confidence
FROM (SELECT {bad} AS n_bad, {rows} AS n_rows, {example} AS example FROM {source}) f"""


def _row_check(check, table_name, column, issue, condition, confidence, source, text=None):
    text = text or f"CAST({column} AS VARCHAR)"
    return _finding(check, table_name, column, issue, f"COUNT(*) FILTER (WHERE {condition})",
                    f"MIN({text}) FILTER (WHERE {condition})", confidence, source)


_MISSING = f"c_mktsegment IS NULL OR lower(trim(c_mktsegment)) IN {TOKENS_SQL}"
_RECORD_NAME = ",".join(RECORD)
_NULLS = " UNION ALL ".join((
    _row_check("missing", "customer", "c_mktsegment", "missing", _MISSING, 0.9, "customers"),
    _row_check("null", "customer", "c_nationkey", "null", "c_nationkey IS NULL", 0.9, "customers"),
))
_COPIES = " UNION ALL ".join((
    _finding("exact_duplicates", "customer", _RECORD_NAME, "exact_duplicate",
             f"({_excess('customers', ', '.join(RECORD))})", "CAST(NULL AS VARCHAR)", 0.88, "customers"),
    _finding("near_duplicates", "customer", _RECORD_NAME, "near_duplicate_pattern",
             f"(SELECT COALESCE(SUM(n_new), 0) FROM ({NEAR_OF_CUSTOMERS}) g)",
             f"(SELECT printf('%d groups, %d rows', COUNT(*), COALESCE(SUM(n_rows), 0)) FROM ({NEAR_OF_CUSTOMERS}) g)", 0.55,
             "customers"),
))
NULLS_DUPLICATES = f"WITH {DIRTY_CUSTOMERS} {_NULLS} UNION ALL {_COPIES}"


def _nulls_duplicates(spark, sf) -> dict:
    return {"df": dirty_customers(spark, sf), "table_name": "customer", "missing": ["c_mktsegment"], "nulls": ["c_nationkey"],
            "records": RECORD, "anchors": ["c_name"]}


@query(NULLS_DUPLICATES)
def audit_nulls_duplicates(spark, sf):
    return _rounded(A.audit_nulls_duplicates(**_nulls_duplicates(spark, sf)))


CONFORMANCE = f"WITH {ORDERS_AS_TEXT} " + " UNION ALL ".join((
    _row_check("number_type", "orders", "o_totalprice", "type_violation", NEEDS_CLEANING, 0.93, "dirty_orders"),
    _row_check("iso_format", "orders", "o_orderdate", "date_format_violation", NEEDS_REFORMAT, 0.92, "dirty_orders"),
    _row_check("not_negative", "orders", "quantity", "negative_value", "quantity < 0", 0.9, "dirty_orders"),
    _row_check("parseable", "orders", "o_totalprice", "unparseable", NOT_NUMBER, 0.88, "dirty_orders"),
))


def _conformance(spark, sf) -> dict:
    return {"df": orders_as_text(spark, sf), "table_name": "orders", "amounts": ["o_totalprice"], "dates": ["o_orderdate"],
            "not_negative": ["quantity"]}


@query(CONFORMANCE)
def audit_conformance(spark, sf):
    return _rounded(A.audit_conformance(**_conformance(spark, sf)))


_NOVEL = "cur c LEFT JOIN (SELECT DISTINCT user_id FROM base) b ON c.user_id = b.user_id"
_MEANS = "(SELECT (SELECT AVG(value) FROM base) AS b, (SELECT AVG(value) FROM cur) AS c) m"
_STATS = "(" + " UNION ALL ".join(
    f"SELECT '{name}' AS name, (SELECT {f} FROM base) AS b, (SELECT {f} FROM cur) AS c"
    for name, f in (("stddev", "stddev_samp(value)"), *((f"p{int(q * 100)}", f"quantile_cont(value, {q})") for q in (0.25, 0.5, 0.75)))
) + ") m"
_MOVED = "abs(c - b) > 0.05 * (SELECT stddev_samp(value) FROM base)"
DRIFT = f"WITH {SNAPSHOTS} " + " UNION ALL ".join((
    f"""SELECT 'mean_shift' AS "check", 'events' AS table_name, 'value' AS column_name, 'mean_shift' AS issue_type,
  CASE WHEN abs(c - b) > 0.05 * abs(b) THEN n ELSE 0 END AS n_bad, n AS n_rows, ROUND(abs(c - b) / abs(b), 9) AS rate,
  printf('mean shift from %.2f to %.2f', b, c) AS example, CAST(0.9 AS DOUBLE) AS confidence
FROM {_MEANS}, (SELECT COUNT(*) AS n FROM cur) s""",
    f"""SELECT 'distribution_shift', 'events', 'value', 'distribution_shift', CASE WHEN bool_or({_MOVED}) THEN any_value(n) ELSE 0 END,
  any_value(n), ROUND(max(abs(c - b)) / (SELECT stddev_samp(value) FROM base), 9),
  'moved: ' || string_agg(name, ', ' ORDER BY name) FILTER (WHERE {_MOVED}), CAST(0.9 AS DOUBLE)
FROM {_STATS}, (SELECT COUNT(*) AS n FROM cur) s""",
    f"""SELECT 'new_category', 'events', 'event_type', 'new_category', k.n, s.n,
  ROUND(CAST(k.n AS DOUBLE) / s.n, 9), k.event_type, CAST(0.85 AS DOUBLE)
FROM (SELECT event_type, COUNT(*) AS n FROM cur WHERE event_type IS NOT NULL
      AND event_type NOT IN (SELECT event_type FROM base) GROUP BY 1) k, (SELECT COUNT(*) AS n FROM cur) s""",
    _finding("novel_reference", "events", "user_id", "referential_drift",
             "COUNT(*) FILTER (WHERE b.user_id IS NULL)",
             "printf('%.1f%%', 100.0 * COUNT(*) FILTER (WHERE b.user_id IS NULL) / COUNT(*))", 0.83, _NOVEL),
))


def _drift(spark, sf) -> dict:
    base, current = snapshots(spark, sf)
    return {"base": base, "current": current, "table_name": "events", "measures": ["value"], "categories": ["event_type"],
            "references": ["user_id"], "distributions": ["value"]}


@query(DRIFT)
def audit_drift(spark, sf):
    return _rounded(A.audit_drift(**_drift(spark, sf)))


# events whose values are reversed, gone, raised by 4 % and by 6 %
_VERDICTS = {"same": "value", "gone": "CAST(NULL AS DOUBLE)", "under": "value * 1.04", "over": "value * 1.06"}


@query(" UNION ALL ".join(f"""SELECT '{name}' AS snapshot, CAST(CASE WHEN c IS NULL OR abs(c - b) > 0.05 * abs(b) THEN n ELSE 0 END AS BIGINT) AS n_bad,
  CAST(n AS BIGINT) AS n_rows, printf('mean shift from %.2f to ', b) || COALESCE(printf('%.2f', c), 'none') AS example
FROM (SELECT AVG(value) AS b, AVG({value}) AS c, COUNT(*) AS n FROM events) m""" for name, value in _VERDICTS.items()))
def mean_shift_verdicts(spark, sf):
    """No drift for the same values in another order or a move under the threshold."""
    events = table(spark, sf, "events").select("event_id", "value")
    later = {name: events.orderBy(F.desc("event_id")).select(F.expr(value).alias("value"))
             for name, value in _VERDICTS.items()}
    return all_findings(*(
        A.mean_shift_finding(events, current, "events", "value").select(F.lit(name).alias("snapshot"), "n_bad", "n_rows", "example")
        for name, current in later.items()
    ))


_JOINED = "lineitem JOIN orders ON l_orderkey = o_orderkey"
_SUMS = """(SELECT o.o_orderkey, o.o_totalprice, SUM(l_extendedprice) AS s FROM orders o JOIN lineitem
  ON o.o_orderkey = l_orderkey GROUP BY 1, 2) t"""
_OFF = "abs(o_totalprice - s) > 1e-6"
RELATIONAL = f"WITH {ORDERS_WITH_ORPHANS} " + " UNION ALL ".join((
    _finding("orphans", "orders", "o_custkey", "orphaned_fk", "COUNT(*) FILTER (WHERE c_custkey IS NULL)",
             "MIN(CAST(o_custkey AS VARCHAR)) FILTER (WHERE c_custkey IS NULL)", 0.88,
             "dirty_orders LEFT JOIN customer ON o_custkey = c_custkey"),
    _row_check("ordered", "lineitem", "o_orderdate,l_shipdate", "temporal_violation", "l_shipdate < o_orderdate",
               0.87, _JOINED, "CAST(l_shipdate AS VARCHAR)"),
    _finding("aggregate_mismatch", "orders", "o_totalprice", "aggregate_mismatch",
             f"COUNT(*) FILTER (WHERE {_OFF})", f"CAST(MIN(o_orderkey) FILTER (WHERE {_OFF}) AS VARCHAR)", 0.83,
             _SUMS),
))


def _relational(spark, sf) -> dict:
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    shipped = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return {
        "orphans": {"child": orders_with_orphans(spark, sf), "child_name": "orders", "fk": "o_custkey",
                    "parent": table(spark, sf, "customer"), "pk": "c_custkey"},
        "temporal": {"df": shipped, "table_name": "lineitem", "start": "o_orderdate", "end": "l_shipdate"},
        "totals": {"parent": orders, "parent_name": "orders", "pk": "o_orderkey", "total": "o_totalprice",
                   "child": lines, "fk": "l_orderkey", "amount": "l_extendedprice"},
    }


@query(RELATIONAL)
def audit_relational(spark, sf):
    return _rounded(A.audit_relational(**_relational(spark, sf)))


@query(" UNION ALL ".join(f"SELECT * FROM ({sql}) a" for sql in (NULLS_DUPLICATES, CONFORMANCE, DRIFT, RELATIONAL)))
def full_audit(spark, sf):
    return _rounded(A.full_audit(
        [_nulls_duplicates(spark, sf)], [_conformance(spark, sf)], [_drift(spark, sf)], [_relational(spark, sf)]
    ))


_PARENTS = {"empty": ("WHERE FALSE", "false"), "other": ("WHERE c_custkey < 0", "c_custkey < 0"), "all": ("", "true")}


@query(" UNION ALL ".join(f"""SELECT '{name}' AS parents, COUNT(*) FILTER (WHERE c_custkey IS NULL) AS n_bad, COUNT(*) AS n_rows
FROM orders LEFT JOIN (SELECT c_custkey FROM customer {where}) c ON o_custkey = c_custkey""" for name, (where, _) in _PARENTS.items()))
def orphan_findings_of_parents(spark, sf):
    """Every row is an orphan of an empty parent table."""
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    return all_findings(*(
        A.orphan_finding(orders, "orders", "o_custkey", customers.where(where), "c_custkey").select(F.lit(name).alias("parents"), "n_bad", "n_rows")
        for name, (_, where) in _PARENTS.items()
    ))


_SUITE = [
    ("null", "c_nationkey", "null", "c_nationkey IS NULL", 0.9),
    ("disguised_null", "c_mktsegment", "disguised_null", f"lower(trim(c_mktsegment)) IN {TOKENS_SQL}", 0.84),
    ("not_negative", "c_acctbal", "negative_value", "c_acctbal < 0", 0.9),
    ("range", "c_acctbal", "out_of_range", "c_acctbal < -500 OR c_acctbal > 9000", 0.9),
]


def _suite():
    return [
        suite.null("c_nationkey"), suite.disguised_null("c_mktsegment"), suite.not_negative("c_acctbal"),
        suite.in_range("c_acctbal", -500, 9000), suite.null("c_nationkey"),
    ]


@query(f"WITH {CUSTOMERS_WITH_NULLS} " + " UNION ALL ".join(
    _row_check(check, "customer", column, issue, condition, confidence, "customers")
    for check, column, issue, condition, confidence in _SUITE
))
def fused_row_checks(spark, sf):
    return _rounded(suite.run_checks(customers_with_nulls(spark, sf), "customer", _suite()))


@query(f"WITH {CUSTOMERS_WITH_NULLS} SELECT * FROM (SELECT c_custkey, concat_ws(';', "
       + ", ".join(f"CASE WHEN {cond} THEN '{check}:{column}' END" for check, column, _, cond, _ in _SUITE)
       + ") AS failed FROM customers) t WHERE failed <> ''")
def rows_failing_checks(spark, sf):
    rows = suite.failing_rows(customers_with_nulls(spark, sf), _suite())
    return rows.select("c_custkey", F.array_join("failed", ";").alias("failed"))
