"""Reports made from our own audits: graded against the injected truth, and as JSON."""

from pyspark.sql import DataFrame, functions as F

from ..functions import vocabulary as V
from ..operators import evaluate as E, inject as I, relational as R
from ..plans import audits as A, report as P
from ..plans.findings import all_findings, written
from ..sources.catalog import table
from . import query
from .audits import (
    CONFORMANCE, DRIFT, NULLS_DUPLICATES, RELATIONAL, _conformance, _drift, _nulls_duplicates, _relational, _rounded,
)
from .dirty import DIRTY_CUSTOMERS, SNAPSHOTS
from .scoring import _accuracy, _brier, _strict

_AUDITS = {"nulls_duplicates": NULLS_DUPLICATES, "conformance": CONFORMANCE, "drift": DRIFT, "relational": RELATIONAL}
_ALL = " UNION ALL ".join(f"SELECT '{name}' AS audit, f.* FROM ({sql}) f" for name, sql in _AUDITS.items())
FINDINGS = f"findings AS MATERIALIZED ({_ALL})"


def _findings(spark, sf) -> DataFrame:
    frames = {
        "nulls_duplicates": A.audit_nulls_duplicates(**_nulls_duplicates(spark, sf)),
        "conformance": A.audit_conformance(**_conformance(spark, sf)),
        "drift": A.audit_drift(**_drift(spark, sf)),
        "relational": A.audit_relational(**_relational(spark, sf)),
    }
    return written(all_findings(*(_rounded(df).select(F.lit(name).alias("audit"), "*") for name, df in frames.items())))


# --- grading -------------------------------------------------------------------
_CHECKS = (
    "missing", "null", "exact_duplicates", "near_duplicates", "number_type", "iso_format", "not_negative", "parseable", "mean_shift",
    "orphans", "ordered", "aggregate_mismatch",
)
_FACTS = "facts AS MATERIALIZED (SELECT " + ", ".join(
    f"max(n_bad) FILTER (WHERE \"check\" = '{c}') AS n_{c}, max(confidence) FILTER (WHERE \"check\" = '{c}') AS conf_{c}" for c in _CHECKS
) + """, list(example) FILTER (WHERE "check" = 'new_category') AS said,
  CAST(replace(max(example) FILTER (WHERE "check" = 'novel_reference'), '%', '') AS DOUBLE) / 100 AS said_share FROM findings)"""


def _n(check):
    return f"n_{check}"


def _counted(check, actual, above):
    accuracy = _accuracy(_n(check), actual)
    return f"CASE WHEN {_n(check)} > 0 THEN {_brier(accuracy, f'conf_{check}', f'{accuracy} > {above}')} ELSE 0.0 END"


def _seen(check, confidence, credit="1.0"):
    return f"CASE WHEN {_n(check)} > 0 THEN {_brier(credit, confidence, 'TRUE')} ELSE 0.0 END"


_SAID = "said"
_HITS = f"CAST(len(list_intersect({_SAID}, ['crypto', 'NFT'])) AS DOUBLE)"
_F1 = f"(2.0 * ({_HITS} / len({_SAID})) * ({_HITS} / 2) / greatest({_HITS} / len({_SAID}) + {_HITS} / 2, 1e-6))"
_SHARE = "said_share"
_SCORES = {
    "nulls_duplicates": {
        "null_email": _counted("missing", "t.null_text", 0.6), "null_cid": _counted("null", "t.null_key", 0.6),
        "exact_dups": _counted("exact_duplicates", "t.exact_duplicates", 0.6),
        "near_dups": f"CASE WHEN {_n('near_duplicates')} > 0 THEN 0.5 ELSE 0.0 END",
    },
    "conformance": {
        "amount_type": _seen("number_type", 0.93), "date_format": _seen("iso_format", 0.92),
        "neg_qty": _counted("not_negative", "t.negative_quantity", 0.5), "bad_amount": _seen("parseable", 0.5, "0.8"),
    },
    "drift": {
        "mean_shift": _seen("mean_shift", 0.9), "new_cats": _brier(_F1, 0.85, f"{_F1} > 0.4"),
        "ref_drift": f"CASE WHEN abs({_SHARE} - t.reference_share) <= 0.05 THEN {_brier('1.0', 0.83, 'TRUE')} ELSE {_brier('0.5', 0.83, 'FALSE')} END",
    },
    "relational": {
        "orphans": _counted("orphans", "t.orphaned_count", 0.5), "temporal": _counted("ordered", "t.temporal_count", 0.5),
        "aggregates": _counted("aggregate_mismatch", "t.mismatch_count", 0.5),
    },
}
_TRUTH = f"""truth AS MATERIALIZED (SELECT
  (SELECT COUNT(*) FILTER (WHERE c_custkey % 97 = 3 OR c_custkey % 89 = 5) FROM (WITH {DIRTY_CUSTOMERS} SELECT * FROM customers) c) AS null_text,
  (SELECT COUNT(*) FILTER (WHERE c_custkey % 131 = 8) FROM (WITH {DIRTY_CUSTOMERS} SELECT * FROM customers) c) AS null_key,
  (SELECT COUNT(*) FILTER (WHERE c_custkey % 50 = 1) FROM customer) AS exact_duplicates,
  (SELECT COUNT(*) FILTER (WHERE o_orderkey % 61 = 2) FROM orders) AS negative_quantity,
  (SELECT AVG(CASE WHEN event_id % 7 = 0 THEN 1.0 ELSE 0.0 END) FROM (WITH {SNAPSHOTS} SELECT * FROM cur) e) AS reference_share,
  (SELECT COUNT(*) FILTER (WHERE o_orderkey % 211 = 4 OR o_orderkey % 307 = 9) FROM orders) AS orphaned_count,
  (SELECT COUNT(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate) AS temporal_count,
  (SELECT COUNT(*) FROM orders JOIN (SELECT l_orderkey, SUM(l_extendedprice) AS s FROM lineitem GROUP BY 1) l
     ON o_orderkey = l_orderkey WHERE abs(o_totalprice - s) > 1e-6) AS mismatch_count)"""


def _graded(audit):
    total = " + ".join(f"{_strict(f'CAST({score} AS DOUBLE)')} * {V.WEIGHTS[audit][name]}" for name, score in _SCORES[audit].items())
    return f"SELECT '{audit}' AS audit, {_strict(f'CAST(ROUND(CAST({total} AS DECIMAL(18,10)), 4) AS DOUBLE)')} AS total FROM truth t, facts"


@query(f"WITH {FINDINGS}, {_FACTS}, {_TRUTH} " + " UNION ALL ".join(map(_graded, _AUDITS)))
def graded_own_audit(spark, sf):
    """Findings of each audit -> report rows -> grade against what was injected."""
    rows = P.report_rows(_findings(spark, sf), ["audit"]).withColumn(
        "field", F.regexp_replace("field", "^o_totalprice$", "amount")  # the graders look for the word
    )
    orders = table(spark, sf, "orders")
    pick = I.pick_rows
    shipped = _relational(spark, sf)["temporal"]["df"]
    totals = (orders, "o_orderkey", "o_totalprice", table(spark, sf, "lineitem"), "l_orderkey", "l_extendedprice")
    dirty, current = _nulls_duplicates(spark, sf)["df"], _drift(spark, sf)["current"]
    truths = {
        "nulls_duplicates": dirty.agg(
            F.count_if(pick("c_custkey", 97, 3) | pick("c_custkey", 89, 5)).alias("null_text"),
            F.count_if(pick("c_custkey", 131, 8)).alias("null_key"),
        ).withColumn("exact_duplicates", table(spark, sf, "customer").agg(F.count_if(pick("c_custkey", 50, 1))).scalar()),
        "conformance": I.truth(orders, pick("o_orderkey", 61, 2), "negative_quantity"),
        "drift": current.agg(F.avg(F.when(pick("event_id", 7, 0), 1.0).otherwise(0.0)).alias("reference_share")).withColumn(
            "new_categories", F.lit("crypto,NFT")),
        "relational": orders.agg(F.count_if(pick("o_orderkey", 211, 4) | pick("o_orderkey", 307, 9)).alias("orphaned_count"))
        .withColumn("temporal_count", R.temporal_violation_count(shipped, "o_orderdate", "l_shipdate").scalar())
        .withColumn("mismatch_count", R.aggregate_mismatch_count(*totals).scalar()),
    }
    graders = {
        "nulls_duplicates": lambda r, t: E.grade_nulls_duplicates(r, t, "audit", text_field="c_mktsegment", key_field="c_nationkey"),
        "conformance": lambda r, t: E.grade_conformance(r, t, "audit"),
        "drift": lambda r, t: E.grade_drift(r, t, "audit", measure="value", category="event_type"),
        "relational": lambda r, t: E.grade_relational(r, t, "audit"),
    }
    return all_findings(*(
        grade(rows.where(F.col("audit") == name), truths[name].withColumn("audit", F.lit(name))).select("audit", "total")
        for name, grade in graders.items()
    ))


def _case(mapping):
    return "CASE issue_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


# --- the report and its parts ----------------------------------------------------
@query(f"WITH {FINDINGS} SELECT DISTINCT audit, issue_type, {_case(V.FIXES)} AS fix FROM findings WHERE n_bad > 0")
def recommended_fixes(spark, sf):
    return P.recommended_fixes(_findings(spark, sf), ["audit"])


_DRIFTED = f"""kinds AS (
  SELECT column_name, issue_type, string_agg(DISTINCT example, ',' ORDER BY example) AS text, any_value(confidence) AS confidence,
         list_position({list(V.REPORT_SECTIONS)}, issue_type) AS place
  FROM findings WHERE n_bad > 0 AND audit = 'drift' GROUP BY 1, 2),
drifted AS (
  SELECT column_name, string_agg(text, '; ' ORDER BY place) AS text, arg_min(confidence, place) AS confidence FROM kinds GROUP BY 1)"""


@query(f"WITH {FINDINGS}, {_DRIFTED} SELECT column_name, text, confidence FROM drifted")
def drifted_columns(spark, sf):
    return P.drifted_columns(_findings(spark, sf).where("audit = 'drift'"))


def _item(section):
    return f"""SELECT audit, '{section}' AS section, column_name AS field, issue_type, example AS value, n_bad AS n_reported, confidence
FROM findings WHERE n_bad > 0 AND {_case(V.REPORT_SECTIONS)} = '{section}'"""


_STATEMENTS = f"""statements AS (
  SELECT audit, 'null_issues' AS section, column_name AS field, NULL AS issue_type, CAST(n_bad AS VARCHAR) AS value, n_bad AS n_reported, confidence
  FROM findings WHERE n_bad > 0 AND "check" IN ('missing', 'null')
  UNION ALL SELECT audit, 'duplicate_row_count', NULL, NULL, CAST(n_bad AS VARCHAR), n_bad, confidence FROM findings
    WHERE n_bad > 0 AND "check" = 'exact_duplicates'
  UNION ALL {_item('schema_violations')} UNION ALL {_item('relational_issues')}
  UNION ALL SELECT 'drift', 'drift_details', column_name, NULL, text, NULL, confidence FROM drifted
  UNION ALL SELECT 'drift', 'drifted_columns', column_name, NULL, column_name, NULL, NULL FROM drifted
  UNION ALL SELECT DISTINCT audit, 'recommended_fixes', {_case(V.FIXES)}, NULL, {_case(V.FIXES)}, NULL, NULL FROM findings WHERE n_bad > 0)"""


@query(f"""WITH {FINDINGS}, {_DRIFTED}, {_STATEMENTS}
SELECT audit, section, CAST(row_number() OVER (PARTITION BY audit, section ORDER BY field NULLS FIRST, issue_type NULLS FIRST, value NULLS FIRST) - 1 AS INTEGER) AS seq,
  field, issue_type, value, n_reported, confidence FROM statements""")
def audit_report_rows(spark, sf):
    return P.report_rows(_findings(spark, sf), ["audit"])


def _array(section, fields):
    return f"""'[' || COALESCE((SELECT string_agg('{{' || concat_ws(',', {fields}) || '}}', ',' ORDER BY field, issue_type)
  FROM statements s WHERE s.audit = a.audit AND section = '{section}'), '') || ']'"""


def _map(section, value):
    return f"""'{{' || COALESCE((SELECT string_agg(to_json(field) || ':{{"value":' || {value} || ',"confidence":' || confidence || '}}', ',' ORDER BY field)
  FROM statements s WHERE s.audit = a.audit AND section = '{section}'), '') || '}}'"""


def _names(section):
    return f"""'[' || COALESCE((SELECT string_agg(to_json(field), ',' ORDER BY field) FROM statements s
  WHERE s.audit = a.audit AND section = '{section}'), '') || ']'"""


_ITEM_FIELDS = """'"column":' || to_json(field), '"issue_type":' || to_json(issue_type),
  CASE WHEN value IS NOT NULL THEN '"example":' || to_json(value) END, '"count":' || n_reported, '"confidence":' || confidence"""


@query(f"""WITH {FINDINGS}, {_DRIFTED}, {_STATEMENTS}
SELECT audit, '{{"null_issues":' || {_map('null_issues', 'n_reported')} || ',"duplicate_row_count":'
  || COALESCE((SELECT '{{"value":' || n_reported || ',"confidence":' || confidence || '}}' FROM statements s
     WHERE s.audit = a.audit AND section = 'duplicate_row_count'), '{{"value":0,"confidence":0.5}}')
  || ',"schema_violations":' || {_array('schema_violations', _ITEM_FIELDS)} || ',"drifted_columns":' || {_names('drifted_columns')}
  || ',"drift_details":' || {_map('drift_details', 'to_json(value)')} || ',"relational_issues":' || {_array('relational_issues', _ITEM_FIELDS)}
  || ',"recommended_fixes":' || {_names('recommended_fixes')} || '}}' AS report
FROM (SELECT DISTINCT audit FROM statements) a""")
def audit_reports_as_json(spark, sf):
    return P.report_json(P.report_rows(_findings(spark, sf), ["audit"]), ["audit"])
