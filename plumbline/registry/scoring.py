"""Grading: every order stands for one audit run with a report and a truth."""

from pyspark.sql import DataFrame, functions as F

from ..functions import scoring as S
from ..operators import evaluate as E, reports as R
from ..sources.catalog import table
from . import query

# Report text, one expression valid in both engines. Sections are sometimes
# missing, null or of the wrong type, values sometimes bare.
_K, _C = "o_orderkey", "o_custkey"


def _text(expression):
    return f"CAST({expression} AS STRING)"


REPORT = f"""'{{' ||
CASE {_K} % 9 WHEN 0 THEN '"null_issues": null, ' WHEN 1 THEN '"null_issues": [1, 2], ' WHEN 2 THEN ''
  ELSE '"null_issues": {{"email": {{"value": ' || {_text(f'{_C} % 13 + {_K} % 4')} || ', "confidence": 0.'
       || {_text(f'{_K} % 10')} || '}}, "customer_id": ' || {_text(f'{_C} % 5')} || '}}, ' END ||
CASE {_K} % 5 WHEN 0 THEN '"duplicate_row_count": ' || {_text(f'{_C} % 11')} || ', '
  WHEN 1 THEN '"duplicate_row_count": {{"value": ' || {_text(f'{_C} % 11 + {_K} % 2')} || ', "confidence": 0.9}}, '
  WHEN 2 THEN '"duplicate_row_count": "many", '
  WHEN 3 THEN '"duplicate_row_count": {{"value": ' || {_text(f'{_C} % 11')} || ', "confidence": 0}}, ' ELSE '' END ||
CASE {_K} % 7 WHEN 0 THEN '"schema_violations": [], ' WHEN 1 THEN '"schema_violations": "none", '
  ELSE '"schema_violations": [{{"column": "order_amount", "issue_type": "Type_Violation", "example": "$12.50", "confidence": 0.'
       || {_text(f'{_C} % 10')} || '}}, {{"column": "order_date", "issue_type": "format", "confidence": 0.8}}, '
       || '{{"column": "quantity", "issue_type": "NEGATIVE_value", "count": ' || {_text(f'{_C} % 17 + {_K} % 3')}
       || '}}, {{"column": "customers", "issue_type": "near_duplicate_pattern"}}, '
       || '{{"column": "amount", "issue_type": "' || CASE {_K} % 3 WHEN 0 THEN 'unparseable' ELSE 'other' END
       || '", "count": 4}}], ' END ||
CASE {_K} % 4 WHEN 0 THEN '"drift_details": {{}}, '
  ELSE '"drift_details": {{"amount": {{"value": "' || CASE {_K} % 3 WHEN 0 THEN 'Mean shift' ELSE 'stable' END
       || '", "confidence": 0.9}}, "category": {{"value": "crypto, NFT' || CASE {_K} % 2 WHEN 0 THEN ',food' ELSE '' END
       || '", "confidence": 0.7}}, "user_id": {{"value": "' || CASE {_C} % 4 WHEN 0 THEN '15%' WHEN 1 THEN '0.15'
       WHEN 2 THEN 'Approx 15%' ELSE {_text(f'{_C} % 40')} || ' %' END || '", "confidence": 0.6}}}}, ' END ||
'"relational_issues": [{{"issue_type": "orphaned_fk", "count": ' || {_text(f'{_C} % 19 + {_K} % 2')}
  || ', "confidence": 0.88}}, {{"issue_type": "' || CASE {_K} % 3 WHEN 0 THEN 'temporal_violation' ELSE 'late ship_date' END
  || '", "count": ' || {_text(f'{_C} % 23')} || '}}, {{"issue_type": "' || CASE {_K} % 5 WHEN 0 THEN 'clean'
  ELSE 'total off' END || '", "count": "' || {_text(f'{_C} % 7')} || '", "confidence": 0.83}}], ' ||
'"drifted_columns": ["amount", "amount", "user_id"], "recommended_fixes": [' ||
CASE {_K} % 8 WHEN 0 THEN '"Monitor categories"' ELSE '"Cast amounts"' END || ']}}'"""

REPORTS = f"reports AS (SELECT o_orderkey AS run_id, o_custkey AS c, {REPORT} AS report FROM orders)"


def _runs(spark, sf) -> DataFrame:
    """One run per order, spread by run while rows are still two numbers wide:
    reading a report is heavy work for few input bytes, and both the fold by run
    and the join with the truth then find their partitioning."""
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    runs = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("run_id"))
    return runs.repartition(n, "run_id")


def _reports(spark, sf) -> DataFrame:
    return _runs(spark, sf).select("run_id", F.expr(REPORT).alias("report"))


def _rows(spark, sf, sections=R.SECTIONS) -> DataFrame:
    return R.parse_reports(_reports(spark, sf), ["run_id"], sections=sections)


def _count(x):
    return f"CAST(trunc(try_cast({x} AS DOUBLE)) AS BIGINT)"


def _map_section(name):
    value = "CASE WHEN json_type(v) = 'OBJECT' THEN json_extract_string(v, '$.value') ELSE json_extract_string(v, '$') END"
    return f"""SELECT run_id, '{name}' AS section, CAST(i AS INTEGER) AS seq, k AS field, CAST(NULL AS VARCHAR) AS issue_type,
  {value} AS value, {_count(value)} AS n_reported,
  CASE WHEN json_type(v) = 'OBJECT' THEN COALESCE(CAST(json_extract_string(v, '$.confidence') AS DOUBLE), 0.5)
       ELSE 0.5 END AS confidence
FROM (SELECT run_id, unnest(json_keys(report, '$.{name}')) AS k, unnest(json_extract(report, '$.{name}.*')) AS v,
             unnest(range(0, len(json_keys(report, '$.{name}')))) AS i
      FROM reports WHERE json_type(report, '$.{name}') = 'OBJECT') b"""


def _item_section(name):
    def at(key):
        return f"json_extract_string(v, '$.{key}')"

    return f"""SELECT run_id, '{name}', CAST(i AS INTEGER), {at('column')}, {at('issue_type')}, {at('example')},
  COALESCE({_count(at('count'))}, 0), COALESCE(CAST({at('confidence')} AS DOUBLE), 0.5)
FROM (SELECT run_id, unnest(json_extract(report, '$.{name}[*]')) AS v,
             unnest(range(0, CAST(json_array_length(report, '$.{name}') AS BIGINT))) AS i
      FROM reports WHERE json_type(report, '$.{name}') = 'ARRAY') b"""


def _list_section(name):
    item = "json_extract_string(v, '$')"
    return f"""SELECT run_id, '{name}', CAST(i AS INTEGER), {item}, NULL, {item}, NULL, NULL
FROM (SELECT run_id, unnest(json_extract(report, '$.{name}[*]')) AS v,
             unnest(range(0, CAST(json_array_length(report, '$.{name}') AS BIGINT))) AS i
      FROM reports WHERE json_type(report, '$.{name}') = 'ARRAY') b"""


_DUP = "json_extract(report, '$.duplicate_row_count')"
_DUP_COUNT = f"""COALESCE({_count(f"CASE WHEN json_type({_DUP}) = 'OBJECT' THEN json_extract_string({_DUP}, '$.value') ELSE json_extract_string({_DUP}, '$') END")}, 0)"""
_DUP_ROWS = f"""SELECT run_id, 'duplicate_row_count', 0, NULL, NULL, CAST({_DUP_COUNT} AS VARCHAR), {_DUP_COUNT},
  COALESCE(NULLIF(CAST(json_extract_string({_DUP}, '$.confidence') AS DOUBLE), 0), 0.5) FROM reports"""
PARSED = f"{REPORTS}, parsed AS MATERIALIZED (" + " UNION ALL ".join((
    _map_section("null_issues"), _map_section("drift_details"), _DUP_ROWS,
    _item_section("schema_violations"), _item_section("relational_issues"),
    _list_section("drifted_columns"), _list_section("recommended_fixes"),
)) + ")"


@query(f"WITH {PARSED} SELECT * FROM parsed")
def parsed_reports(spark, sf):
    return _rows(spark, sf)


# --- the truth each run is graded against -------------------------------------
TRUTH = """truth AS (
  SELECT o_orderkey AS run_id, CAST(o_custkey % 13 AS BIGINT) AS null_text, CAST(o_custkey % 5 AS BIGINT) AS null_key,
         CAST(o_custkey % 11 AS BIGINT) AS exact_duplicates, CAST(o_custkey % 17 AS BIGINT) AS negative_quantity,
         CASE o_custkey % 3 WHEN 0 THEN 'crypto,NFT' WHEN 1 THEN 'crypto' ELSE '' END AS new_categories,
         CAST(0.15 AS DOUBLE) AS reference_share, CAST(o_custkey % 19 AS BIGINT) AS orphaned_count,
         CAST(o_custkey % 23 + 1 AS BIGINT) AS temporal_count, CAST(o_custkey % 7 AS BIGINT) AS mismatch_count
  FROM orders)"""


def _truth(spark, sf) -> DataFrame:
    cust = F.col("o_custkey")
    return _runs(spark, sf).select(
        "run_id", (cust % 13).alias("null_text"), (cust % 5).alias("null_key"),
        (cust % 11).alias("exact_duplicates"), (cust % 17).alias("negative_quantity"),
        F.when(cust % 3 == 0, "crypto,NFT").when(cust % 3 == 1, "crypto").otherwise("").alias("new_categories"),
        F.lit(0.15).alias("reference_share"), (cust % 19).alias("orphaned_count"),
        (cust % 23 + 1).alias("temporal_count"), (cust % 7).alias("mismatch_count"),
    )


def _accuracy(reported, actual):
    ratio = f"(abs(CAST({reported} AS DOUBLE) - {actual}) / {actual})"
    return f"""(CASE WHEN {actual} = 0 THEN CASE WHEN {reported} = 0 THEN 1.0 ELSE 0.0 END
  WHEN {ratio} <= 0.15 THEN greatest(0.0, 1.0 - {ratio} / 0.15) ELSE greatest(0.0, 1.0 - {ratio}) END)"""


def _brier(base, confidence, correct):
    return f"({base} * (1.0 - 0.3 * power({confidence} - CASE WHEN {correct} THEN 1.0 ELSE 0.0 END, 2)))"


def _first(condition):
    """The first statement of each run that meets the condition."""
    return f"""(SELECT run_id, arg_min(value, seq) AS v, arg_min(n_reported, seq) AS n, arg_min(confidence, seq) AS conf
  FROM parsed WHERE {condition} GROUP BY run_id)"""


def _graded(alias, actual, above):
    accuracy = _accuracy(f"{alias}.n", actual)
    return f"(CASE WHEN {alias}.run_id IS NULL THEN 0.0 ELSE {_brier(accuracy, f'{alias}.conf', f'{accuracy} > {above}')} END)"


def _strict(x):
    return f"(CASE WHEN {x} IS NULL OR {x} <= 0 THEN 1e-6 WHEN {x} >= 1 THEN 1.0 - 1e-6 ELSE {x} END)"


def _grader_sql(lookups, scores, weights):
    joins = " ".join(f"LEFT JOIN {_first(c)} {a} ON {a}.run_id = t.run_id" for a, c in lookups.items())
    parts = ", ".join(f"CAST({s} AS DOUBLE) AS {n}" for n, s in scores.items())
    clamped = ", ".join(f"CAST({_strict(n)} AS DOUBLE) AS {n}" for n in scores)
    shown = ", ".join(f"ROUND({n}, 6) AS {n}" for n in scores)
    total = " + ".join(f"{n} * {w}" for n, w in weights.items())
    return f"""WITH {PARSED}, {TRUTH}, scored AS (SELECT t.run_id, {parts} FROM truth t {joins}),
clamped AS (SELECT run_id, {clamped} FROM scored)
SELECT run_id, {shown}, {_strict(f'CAST(ROUND(CAST({total} AS DECIMAL(18,10)), 4) AS DOUBLE)')} AS total FROM clamped"""


def _shown(df: DataFrame) -> DataFrame:
    scores = [c for c in df.columns if c not in ("run_id", "total")]
    return df.select("run_id", *(F.round(c, 6).alias(c) for c in scores), "total")


@query(_grader_sql(
    {"e": "section = 'null_issues' AND field = 'email'", "k": "section = 'null_issues' AND field = 'customer_id'",
     "d": "section = 'duplicate_row_count'",
     "n": "section = 'schema_violations' AND contains(lower(issue_type), 'near')"},
    {"null_email": _graded("e", "null_text", 0.6), "null_cid": _graded("k", "null_key", 0.6),
     "exact_dups": _graded("d", "exact_duplicates", 0.6),
     "near_dups": "CASE WHEN n.run_id IS NULL THEN 0.0 ELSE 0.5 END"},
    {"null_email": 0.30, "null_cid": 0.25, "exact_dups": 0.30, "near_dups": 0.15},
))
def graded_nulls_duplicates(spark, sf):
    return _shown(E.grade_nulls_duplicates(_rows(spark, sf, E.NULLS_SECTIONS), _truth(spark, sf), "run_id"))


_AMOUNT = "section = 'schema_violations' AND contains(lower(field), 'amount')"
_DETECTED = "CASE WHEN {0}.run_id IS NULL THEN 0.0 ELSE {1} END"


@query(_grader_sql(
    {"a": _AMOUNT, "ty": f"{_AMOUNT} AND contains(lower(issue_type), 'type')",
     "d": "section = 'schema_violations' AND contains(lower(field), 'date')",
     "q": """section = 'schema_violations' AND contains(lower(field), 'quantity')
             AND contains(lower(issue_type), 'negative')""",
     "u": f"""section = 'schema_violations' AND (contains(lower(issue_type), 'unparseable')
             OR (contains(lower(field), 'amount') AND contains(lower(issue_type), 'invalid')))"""},
    {"amount_type": _DETECTED.format("ty", _brier("1.0", "a.conf", "TRUE")),
     "date_format": _DETECTED.format("d", _brier("1.0", "d.conf", "TRUE")),
     "neg_qty": _graded("q", "negative_quantity", 0.5),
     "bad_amount": _DETECTED.format("u", _brier("0.8", "0.5", "TRUE"))},
    {"amount_type": 0.25, "date_format": 0.25, "neg_qty": 0.25, "bad_amount": 0.25},
))
def graded_conformance(spark, sf):
    return _shown(E.grade_conformance(_rows(spark, sf, E.CONFORMANCE_SECTIONS), _truth(spark, sf), "run_id"))


_ENTRY = "section = 'drift_details' AND field = '{}'"
_SET = "list_distinct(list_filter(list_transform(string_split({}, ','), lambda x: trim(x)), lambda x: x <> ''))"
_REPORTED, _ACTUAL = _SET.format("COALESCE(c.v, '')"), _SET.format("new_categories")
_HITS = f"CAST(len(list_intersect({_REPORTED}, {_ACTUAL})) AS DOUBLE)"
_PRECISION = f"({_HITS} / greatest(len({_REPORTED}), 1))"
_RECALL = f"({_HITS} / greatest(len({_ACTUAL}), 1))"
_F1 = f"(2.0 * {_PRECISION} * {_RECALL} / greatest({_PRECISION} + {_RECALL}, 1e-6))"
_SHIFTED = "(contains(lower(m.v), 'shift') OR contains(lower(m.v), 'mean'))"
_NUMBER = "try_cast(split_part(trim(replace({0}, '%', ' ')), ' ', 1) AS DOUBLE)"
_PCT = f"(CASE WHEN {_NUMBER.format('u.v')} > 1 THEN {_NUMBER.format('u.v')} / 100.0 ELSE {_NUMBER.format('u.v')} END)"
_CLOSE = f"(abs({_PCT} - reference_share) <= 0.05)"


@query(_grader_sql(
    {"m": _ENTRY.format("amount"), "c": _ENTRY.format("category"), "u": _ENTRY.format("user_id"),
     "w": """section IN ('drift_details', 'recommended_fixes') AND (
       contains(lower(field || ' ' || value), 'categor') OR contains(lower(field || ' ' || value), 'crypto')
       OR contains(lower(field || ' ' || value), 'nft'))"""},
    {"mean_shift": f"CASE WHEN {_SHIFTED} THEN {_brier('1.0', 'm.conf', 'TRUE')} ELSE 0.0 END",
     "new_cats": f"""CASE WHEN c.run_id IS NOT NULL THEN {_brier(_F1, 'c.conf', f'{_F1} > 0.4')}
       WHEN w.run_id IS NOT NULL THEN 0.3 ELSE 0.0 END""",
     "ref_drift": f"""CASE WHEN u.run_id IS NULL THEN 0.0 WHEN {_PCT} IS NULL THEN 0.2
       WHEN {_CLOSE} THEN {_brier('1.0', 'u.conf', 'TRUE')} ELSE {_brier('0.5', 'u.conf', 'FALSE')} END"""},
    {"mean_shift": 0.40, "new_cats": 0.35, "ref_drift": 0.25},
))
def graded_drift(spark, sf):
    return _shown(E.grade_drift(_rows(spark, sf, E.DRIFT_SECTIONS), _truth(spark, sf), "run_id"))


def _issue(word):
    return f"section = 'relational_issues' AND contains(lower(issue_type), '{word}')"


def _either(*aliases):
    """The grade of the first lookup that found anything."""
    branches = " ".join(f"WHEN {a}.run_id IS NOT NULL THEN {g}" for a, g in aliases)
    return f"CASE {branches} ELSE 0.0 END"


@query(_grader_sql(
    {"o1": _issue("orphan"), "o2": _issue("foreign_key"), "t1": _issue("temporal"), "t2": _issue("ship_date"),
     "a1": _issue("aggregate"), "a2": _issue("mismatch"), "a3": _issue("total")},
    {name: _either(*((a, _graded(a, actual, 0.5)) for a in aliases))
     for name, aliases, actual in (("orphans", ("o1", "o2"), "orphaned_count"),
                                   ("temporal", ("t1", "t2"), "temporal_count"),
                                   ("aggregates", ("a1", "a2", "a3"), "mismatch_count"))},
    {"orphans": 0.40, "temporal": 0.35, "aggregates": 0.25},
))
def graded_relational(spark, sf):
    return _shown(E.grade_relational(_rows(spark, sf, E.RELATIONAL_SECTIONS), _truth(spark, sf), "run_id"))


# --- single formulas over rows of the tables ------------------------------------
@query(f"""WITH counts AS (
  SELECT o_custkey, COUNT(*) AS actual, COUNT(*) FILTER (WHERE o_orderpriority <> '1-URGENT') AS reported,
         CAST(o_custkey % 11 AS DOUBLE) / 10 AS confidence FROM orders GROUP BY 1)
SELECT o_custkey, ROUND({_accuracy('reported', 'actual')}, 6) AS accuracy,
       ROUND({_brier(_accuracy('reported', 'actual'), 'confidence', _accuracy('reported', 'actual') + ' > 0.6')}, 6) AS score,
       ROUND(greatest(0.0, 1.0 - CAST(actual - reported AS DOUBLE) / actual), 6) AS monotone_accuracy
FROM counts""")
def count_accuracy_scores(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("actual"), F.count_if(F.col("o_orderpriority") != "1-URGENT").alias("reported")
    )
    confidence = (F.col("o_custkey") % 11).cast("double") / 10
    accuracy = S.count_accuracy("reported", "actual")
    return counts.select(
        "o_custkey", F.round(accuracy, 6).alias("accuracy"),
        F.round(S.brier(accuracy, confidence, accuracy > 0.6), 6).alias("score"),
        F.round(S.count_accuracy("reported", "actual", monotone=True), 6).alias("monotone_accuracy"),
    )


SHARE_TEXT = """CASE event_id % 6 WHEN 0 THEN CAST(user_id % 40 AS STRING) || '%'
  WHEN 1 THEN '0.' || CAST(10 + user_id % 20 AS STRING) WHEN 2 THEN 'Approx ' || CAST(user_id AS STRING) || '%'
  WHEN 3 THEN '  ' || CAST(user_id % 100 AS STRING) || ' percent' WHEN 4 THEN '' ELSE NULL END"""
_EVENT_NUMBER = _NUMBER.format("said")
_EVENT_PCT = f"(CASE WHEN {_EVENT_NUMBER} > 1 THEN {_EVENT_NUMBER} / 100.0 ELSE {_EVENT_NUMBER} END)"


@query(f"""WITH said AS (SELECT event_id, {SHARE_TEXT} AS said FROM events)
SELECT event_id, ROUND({_EVENT_PCT}, 9) AS reported_share,
       ROUND(CASE WHEN {_EVENT_PCT} IS NULL THEN 0.2
            WHEN abs({_EVENT_PCT} - 0.1525) <= 0.05 THEN {_brier('1.0', '0.8', 'TRUE')}
            ELSE {_brier('0.5', '0.8', 'FALSE')} END, 6) AS score FROM said""")
def share_scores(spark, sf):
    said = table(spark, sf, "events").select("event_id", F.expr(SHARE_TEXT).alias("said"))
    return said.select(
        "event_id", F.round(S.share_from_text("said"), 9).alias("reported_share"),
        F.round(S.share_score(S.share_from_text("said"), F.lit(0.8), F.lit(0.1525)), 6).alias("score"),
    )


@query("""WITH sets AS (
  SELECT user_id, string_agg(DISTINCT event_type, ', ') FILTER (WHERE value > 60) AS said,
         list_distinct(list(event_type) FILTER (WHERE value > 100)) AS truth,
         list_distinct(list(event_type) FILTER (WHERE value > 60)) AS reported FROM events GROUP BY 1),
parts AS (SELECT user_id, COALESCE(len(reported), 0) AS r, COALESCE(len(truth), 0) AS t,
                 COALESCE(len(list_intersect(reported, truth)), 0) AS h FROM sets)
SELECT user_id, ROUND(2.0 * (h / greatest(r, 1)) * (h / greatest(t, 1))
       / greatest(h / greatest(r, 1) + h / greatest(t, 1), 1e-6), 6) AS f1 FROM parts""")
def category_f1(spark, sf):
    # sets of event types: as long as there are types, whatever the number of events
    events = table(spark, sf, "events")
    sets = events.groupBy("user_id").agg(
        F.array_join(F.collect_set(F.when(F.col("value") > 60, F.col("event_type"))), ", ").alias("said"),
        F.collect_set(F.when(F.col("value") > 100, F.col("event_type"))).alias("truth"),
    )
    return sets.select("user_id", F.round(S.set_f1(S.category_set("said"), F.col("truth")), 6).alias("f1"))


# --- summaries over runs ---------------------------------------------------------
_SCORES = """scores AS (
  SELECT o_orderpriority AS task, o_orderkey, CAST(o_custkey % 101 AS DOUBLE) / 100
         - CASE WHEN o_orderpriority = '2-HIGH' AND o_orderkey % 2 = 1 THEN 0.3 ELSE 0.0 END AS total
  FROM orders)"""


def _scores(spark, sf):
    dropped = (F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderkey") % 2 == 1)
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("task"), "o_orderkey",
        ((F.col("o_custkey") % 101).cast("double") / 100 - F.when(dropped, 0.3).otherwise(0.0)).alias("total"),
    )


@query(f"""WITH {_SCORES}
SELECT task, COUNT(*) AS n_runs, ROUND(AVG(total), 6) AS mean_score, ROUND(stddev_samp(total), 6) AS stddev_score
FROM scores GROUP BY 1""")
def run_summary(spark, sf):
    summary = E.summarise_runs(_scores(spark, sf), "task")
    return summary.select("task", "n_runs", *(F.round(c, 6).alias(c) for c in ("mean_score", "stddev_score")))


@query(f"""WITH {_SCORES}, b AS (SELECT task, AVG(total) AS m FROM scores WHERE o_orderkey % 2 = 0 GROUP BY 1),
c AS (SELECT task, AVG(total) AS m FROM scores WHERE o_orderkey % 2 = 1 GROUP BY 1)
SELECT c.task, ROUND(b.m, 6) AS baseline_mean, ROUND(c.m, 6) AS mean_score, b.m - c.m > 0.08 AS is_regression
FROM c LEFT JOIN b ON b.task = c.task""")
def run_regressions(spark, sf):
    scores = _scores(spark, sf)
    earlier = E.summarise_runs(scores.where(F.col("o_orderkey") % 2 == 0), "task")
    later = E.summarise_runs(scores.where(F.col("o_orderkey") % 2 == 1), "task")
    return E.flag_regressions(later, earlier, "task").select(
        "task", *(F.round(c, 6).alias(c) for c in ("baseline_mean", "mean_score")), "is_regression"
    )


# --- merging two reports of a run ---------------------------------------------------
_MERGED = f"""WITH {PARSED},
second AS (SELECT p.* REPLACE (p.run_id - 1 AS run_id) FROM parsed p WHERE p.run_id % 2 = 1),
both_rows AS (SELECT *, 0 AS priority FROM parsed WHERE run_id % 2 = 0 UNION ALL SELECT *, 1 FROM second),
placed AS (SELECT *, struct_pack(p := priority, s := seq) AS place FROM both_rows),
first_place AS (
  SELECT *, MIN(place) OVER w AS min_place,
         row_number() OVER (PARTITION BY run_id, section, field ORDER BY
           CASE WHEN section = 'duplicate_row_count' THEN n_reported
                WHEN section IN ('drifted_columns', 'recommended_fixes') THEN -priority ELSE priority END DESC,
           CASE WHEN section IN ('drifted_columns', 'recommended_fixes') THEN -seq ELSE seq END DESC,
           value DESC, confidence DESC) AS rn
  FROM placed WINDOW w AS (PARTITION BY run_id, section, field))
SELECT run_id, section, min_place.p AS report, CAST(min_place.s AS BIGINT) AS seq, field, issue_type, value, n_reported, confidence
FROM first_place WHERE section NOT IN ('schema_violations', 'relational_issues') AND rn = 1
UNION ALL
SELECT run_id, section, place.p, CAST(place.s AS BIGINT), field, issue_type, value, n_reported, confidence
FROM placed WHERE section IN ('schema_violations', 'relational_issues')"""


@query(_MERGED)
def merged_reports(spark, sf):
    """The report of each even order, overridden by the one of the next odd order."""
    rows = _rows(spark, sf)
    first = rows.where(F.col("run_id") % 2 == 0)
    second = rows.where(F.col("run_id") % 2 == 1).withColumn("run_id", F.col("run_id") - 1)
    return R.merge_reports(first, second, ["run_id"]).withColumn("seq", F.col("seq").cast("bigint"))


_LINE = """concat_ws('|', section, CAST(report AS VARCHAR), CAST(seq AS VARCHAR), coalesce(field, '~'), coalesce(issue_type, '~'),
  coalesce(value, '~'), coalesce(CAST(n_reported AS VARCHAR), '~'), coalesce(CAST(CAST(round(confidence * 1000000) AS BIGINT) AS VARCHAR), '~'))"""


@query(f"""SELECT run_id, COUNT(*) AS n_statements, md5(array_to_string(list_sort(list({_LINE})), chr(10))) AS statements_md5
FROM ({_MERGED}) m GROUP BY 1""")
def merged_report_digests(spark, sf):
    """One row per merged report: its statements, in order, as a digest."""
    line = F.expr(_LINE.replace("VARCHAR", "STRING"))
    return merged_reports(spark, sf).groupBy("run_id").agg(  # a report is a bounded text
        F.count(F.lit(1)).alias("n_statements"), F.md5(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary")).alias("statements_md5")
    )


@query("""SELECT o_custkey, o_orderstatus, '{"n_orders":' || COUNT(*) || ',"n_urgent":'
  || COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT') || '}' AS report FROM orders GROUP BY 1, 2""")
def findings_as_json(spark, sf):
    from ..sources.sinks import as_report_json

    counts = table(spark, sf, "orders").groupBy("o_custkey", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_orders"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent")
    )
    return as_report_json(counts, ["o_custkey", "o_orderstatus"])
