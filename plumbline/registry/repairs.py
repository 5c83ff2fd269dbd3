"""Repairs and their verification."""

import uuid

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import inject as I, repair as X
from ..plans import audits as A, suite
from ..plans.findings import all_findings
from ..session import ensure_checkpoint_dir
from ..sources.catalog import table
from . import query
from .dirty import (
    CUSTOMERS_WITH_NULLS, ISO_DATE, ORDERS_AS_TEXT, PARSED, RECORD, TEXT_DATE, TOKENS_SQL, customers_with_copies,
    customers_with_nulls, orders_as_text,
)


def _negative_lines(spark, sf):
    return I.negate(table(spark, sf, "lineitem"), "l_quantity", I.pick_rows("l_orderkey", 53, 6))


_NEGATIVE_LINES = """dirty_lines AS (
  SELECT * REPLACE (CASE WHEN l_orderkey % 53 = 6 THEN -abs(l_quantity) ELSE l_quantity END AS l_quantity)
  FROM lineitem)"""


@query(f"""WITH {_NEGATIVE_LINES}
SELECT l_orderkey, l_linenumber, l_partkey,
       CASE WHEN l_quantity < 0 THEN abs(l_quantity) ELSE l_quantity END AS l_quantity,
       CASE WHEN l_quantity < 0 THEN ROUND(-l_quantity * 2, 4) ELSE l_extendedprice END AS l_extendedprice
FROM dirty_lines""")
def conditional_update(spark, sf):
    fixed = X.update(
        _negative_lines(spark, sf),
        {"l_quantity": "ABS(l_quantity)", "l_extendedprice": F.round(-F.col("l_quantity") * 2, 4)},
        where="l_quantity < 0",
    )
    return fixed.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")


@query(f"""WITH {CUSTOMERS_WITH_NULLS}
SELECT c_custkey, c_name, c_nationkey, c_acctbal,
       CASE WHEN lower(trim(c_mktsegment)) IN {TOKENS_SQL} THEN NULL ELSE c_mktsegment END AS c_mktsegment
FROM customers""")
def disguised_nulls_removed(spark, sf):
    return X.disguised_to_null(customers_with_nulls(spark, sf), ["c_mktsegment"])


@query(f"""WITH {ORDERS_AS_TEXT}
SELECT o_orderkey, CAST(TRY_CAST({PARSED} AS DECIMAL(18,2)) AS DOUBLE) AS o_totalprice FROM dirty_orders""")
def currency_repaired(spark, sf):
    return X.currency_to_decimal(orders_as_text(spark, sf), "o_totalprice").select(
        "o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice")
    )


@query(f"""WITH {ORDERS_AS_TEXT}
SELECT o_orderkey, CAST(COALESCE({ISO_DATE}, {TEXT_DATE}) AS VARCHAR) AS o_orderdate FROM dirty_orders""")
def dates_repaired(spark, sf):
    return X.dates_to_iso(orders_as_text(spark, sf), "o_orderdate").select(
        "o_orderkey", F.col("o_orderdate").cast("string").alias("o_orderdate")
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey,
    l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS rn FROM lineitem) t
WHERE rn = 1""")
def duplicates_dropped(spark, sf):
    kept = X.drop_duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate"])
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")


@query(f"""WITH {CUSTOMERS_WITH_NULLS}, flagged AS (
  SELECT c_custkey, c_acctbal, (c_nationkey IS NULL OR c_acctbal < 0) AS bad FROM customers)
SELECT CASE WHEN bad THEN 'rejected' ELSE 'clean' END AS side, COUNT(*) AS n_rows,
       ROUND(SUM(c_acctbal), 2) AS balance FROM flagged GROUP BY 1""")
def quarantine_split(spark, sf):
    bad = F.col("c_nationkey").isNull() | C.out_of_range("c_acctbal", 0)
    clean, rejected = X.quarantine(customers_with_nulls(spark, sf), bad)
    both = clean.select(F.lit("clean").alias("side"), "c_acctbal").unionByName(
        rejected.select(F.lit("rejected").alias("side"), "c_acctbal")
    )
    return both.groupBy("side").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("c_acctbal"), 2).alias("balance")
    )


@query(f"""WITH {CUSTOMERS_WITH_NULLS}
SELECT c_custkey, c_acctbal FROM customers WHERE c_nationkey IS NULL OR c_acctbal < 0""")
def quarantined_rows(spark, sf):
    bad = F.col("c_nationkey").isNull() | C.out_of_range("c_acctbal", 0)
    return X.quarantine(customers_with_nulls(spark, sf), bad)[1].select("c_custkey", "c_acctbal")


_BAD = f"lower(trim(c_mktsegment)) IN {TOKENS_SQL}"


_SURPLUS = "COUNT(*) - COUNT(DISTINCT (c_name, c_nationkey, c_acctbal, c_mktsegment))"


@query(f"""WITH {CUSTOMERS_WITH_NULLS}, {_NEGATIVE_LINES},
copied AS (SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_custkey % 50 = 1), b AS (
  SELECT 'disguised_null' AS "check", 'customer' AS table_name, 'c_mktsegment' AS column_name,
         COUNT(*) FILTER (WHERE {_BAD}) AS n FROM customers
  UNION ALL SELECT 'not_negative', 'lineitem', 'l_quantity', COUNT(*) FILTER (WHERE l_quantity < 0) FROM dirty_lines
  UNION ALL SELECT 'null', 'customer', 'c_nationkey', COUNT(*) FILTER (WHERE c_nationkey IS NULL) FROM customers
  UNION ALL SELECT 'exact_duplicates', 'customer', 'c_name,c_nationkey,c_acctbal,c_mktsegment', {_SURPLUS} FROM copied),
cleaned AS (SELECT CASE WHEN NOT ({_BAD}) THEN c_mktsegment END AS c_mktsegment, c_nationkey FROM customers),
set_right AS (SELECT CASE WHEN l_quantity < 0 THEN abs(l_quantity) ELSE l_quantity END AS l_quantity FROM dirty_lines),
once AS (SELECT DISTINCT c_name, c_nationkey, c_acctbal, c_mktsegment FROM copied),
a AS (
  SELECT 'disguised_null' AS "check", COUNT(*) FILTER (WHERE {_BAD}) AS n FROM cleaned
  UNION ALL SELECT 'not_negative', COUNT(*) FILTER (WHERE l_quantity < 0) FROM set_right
  UNION ALL SELECT 'null', COUNT(*) FILTER (WHERE c_nationkey IS NULL) FROM cleaned
  UNION ALL SELECT 'exact_duplicates', {_SURPLUS} FROM once)
SELECT b."check", b.table_name, b.column_name, b.n AS n_bad_before, a.n AS n_bad_after, b.n - a.n AS n_fixed,
       a.n = 0 AS is_resolved FROM b JOIN a ON b."check" = a."check" ORDER BY 1""")
def repair_verified(spark, sf):
    customers, lines = customers_with_nulls(spark, sf), _negative_lines(spark, sf)
    copies = customers_with_copies(spark, sf)

    def checks(customers, lines, copies):
        # no repair puts the lost nations back: that row stays unresolved
        return all_findings(
            suite.run_checks(customers, "customer", [suite.disguised_null("c_mktsegment"), suite.null("c_nationkey")]),
            suite.run_checks(lines, "lineitem", [suite.not_negative("l_quantity")]),
            A.exact_duplicate_finding(copies, "customer", RECORD),
        )

    return X.compare_findings(
        checks(customers, lines, copies),
        checks(
            X.disguised_to_null(customers, ["c_mktsegment"]),
            X.update(lines, {"l_quantity": "ABS(l_quantity)"}, where="l_quantity < 0"),
            X.drop_duplicates(copies, RECORD),
        ),
    )


_LINE_CHECKS = {"not_negative": "l_quantity < 0", "priced": "l_extendedprice < 1000 * abs(l_quantity)", "discounted": "l_discount > 0.09"}
_FAILED = "list_filter([" + ", ".join(f"CASE WHEN {bad} THEN '{name}' END" for name, bad in _LINE_CHECKS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"""WITH {_NEGATIVE_LINES}, told AS (SELECT *, {_FAILED} AS failed FROM dirty_lines)
SELECT CASE WHEN len(failed) > 0 THEN 'rejected' ELSE 'clean' END AS verdict, array_to_string(failed, ',') AS failed,
  COUNT(*) AS n_rows, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS amount
FROM told GROUP BY 1, 2""")
def split_by_verdict(spark, sf):
    """Lines judged and split in one pass; both sides read back from their files."""
    folder = f"{ensure_checkpoint_dir(spark)}/split-{uuid.uuid4()}"
    clean, rejected = X.split_by_verdict(_negative_lines(spark, sf), _LINE_CHECKS, folder)
    both = all_findings(
        clean.select(F.lit("clean").alias("verdict"), F.lit("").alias("failed"), "l_extendedprice"),
        rejected.select(F.lit("rejected").alias("verdict"), F.array_join("failed", ",").alias("failed"), "l_extendedprice"),
    )
    return both.groupBy("verdict", "failed").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("amount")
    )


_SWAPPED = "CASE WHEN l_quantity < 10 THEN -l_quantity ELSE l_quantity END"
_LINE_AFTER = {"not_negative": f"{_SWAPPED} < 0", "priced": f"l_extendedprice < 1000 * abs({_SWAPPED})", "discounted": "l_discount > 0.09"}


@query(f"WITH {_NEGATIVE_LINES} " + " UNION ALL ".join(f"""SELECT '{name}' AS "check", COUNT(*) AS n_rows, COUNT(*) FILTER (WHERE {bad}) AS n_bad_before,
  COUNT(*) FILTER (WHERE {_LINE_AFTER[name]}) AS n_bad_after, COUNT(*) FILTER (WHERE {bad} AND NOT {_LINE_AFTER[name]}) AS n_fixed,
  COUNT(*) FILTER (WHERE {bad} AND {_LINE_AFTER[name]}) AS n_still_bad, COUNT(*) FILTER (WHERE NOT {bad} AND {_LINE_AFTER[name]}) AS n_newly_broken
FROM dirty_lines""" for name, bad in _LINE_CHECKS.items()))
def update_verified_by_row(spark, sf):
    """A sign repair with too wide a condition: it mends the negative lines and breaks small ones."""
    return X.verified_update(_negative_lines(spark, sf), {"l_quantity": "-l_quantity"}, "l_quantity < 10", _LINE_CHECKS)
