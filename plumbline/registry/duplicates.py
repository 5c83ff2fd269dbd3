"""Exact and near duplicates."""

from ..operators import duplicates as U
from ..sources.catalog import table
from . import query
from .dirty import (
    CUSTOMERS_WITH_COPIES, CUSTOMERS_WITH_NEAR_COPIES, RECORD, customers_with_copies, customers_with_near_copies,
)


def _excess(source, keys):
    return f"""SELECT CAST(COALESCE(SUM(c - 1), 0) AS BIGINT) AS duplicate_rows
FROM (SELECT {keys}, COUNT(*) AS c FROM {source} GROUP BY ALL HAVING COUNT(*) > 1) t"""


@query(f"WITH {CUSTOMERS_WITH_COPIES} {_excess('customers', 'c_name, c_nationkey, c_acctbal, c_mktsegment')}")
def exact_duplicates(spark, sf):
    return U.exact_duplicate_count(customers_with_copies(spark, sf), RECORD)


@query(f"WITH {CUSTOMERS_WITH_COPIES} {_excess('customers', 'c_name, c_nationkey, c_acctbal, c_mktsegment')}")
def exact_duplicates_by_fingerprint(spark, sf):
    return U.exact_duplicate_count_wide(customers_with_copies(spark, sf), RECORD)


@query(_excess("lineitem", "l_orderkey, l_linenumber"))
def repeated_line_keys(spark, sf):
    return U.exact_duplicate_count(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(_excess("documents", "text"))
def repeated_texts(spark, sf):
    return U.exact_duplicate_count_wide(table(spark, sf, "documents"), ["text"])


@query("""SELECT l_orderkey, l_linenumber, COUNT(*) AS n_copies FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1""")
def duplicate_key_groups(spark, sf):
    return U.duplicate_groups(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def _left_out(left_out, extra=""):
    kept = [c for c in RECORD if c not in left_out]
    shown = ", ".join(f"NULL AS {c}" if c in left_out else c for c in RECORD)
    return f"""SELECT '{",".join(left_out)}' AS left_out, {shown}, COUNT(*) AS n_variants{extra},
       CAST(SUM(n) AS BIGINT) AS n_rows FROM marked GROUP BY {", ".join(kept)} HAVING COUNT(*) > 1"""


_RECORDS = f"records AS (SELECT {', '.join(RECORD)}, COUNT(*) AS n FROM customers GROUP BY ALL)"
_ONE = [(c,) for c in RECORD if c != "c_name"]
#: Over whatever table is named ``customers`` where it stands.
NEAR_OF_CUSTOMERS = f"WITH {_RECORDS}, marked AS (SELECT * FROM records)" + " UNION ALL ".join(
    _left_out(s, ", COUNT(*) AS n_new") for s in _ONE
)
_NEAR = f"WITH {CUSTOMERS_WITH_NEAR_COPIES}, " + NEAR_OF_CUSTOMERS.removeprefix("WITH ")


@query(_NEAR)
def near_duplicate_groups(spark, sf):
    return U.near_duplicate_groups(customers_with_near_copies(spark, sf), RECORD, anchors=["c_name"])


@query(f"SELECT COUNT(*) AS n_groups, CAST(COALESCE(SUM(n_new), 0) AS BIGINT) AS n_records FROM ({_NEAR}) g")
def near_duplicate_count(spark, sf):
    return U.near_duplicate_count(customers_with_near_copies(spark, sf), RECORD, anchors=["c_name"])


@query(f"SELECT COUNT(*) AS n_groups, CAST(COALESCE(SUM(n_new), 0) AS BIGINT) AS n_records FROM ({_NEAR}) g")
def near_duplicate_count_by_fingerprint(spark, sf):
    return U.near_duplicate_count_wide(customers_with_near_copies(spark, sf), RECORD, anchors=["c_name"])


_MATCHED = " OR ".join(
    "COUNT(*) OVER (PARTITION BY " + ", ".join(c for c in RECORD if c not in s) + ") > 1" for s in _ONE
)
_TWO = [(a[0], b[0]) for i, a in enumerate(_ONE) for b in _ONE[i + 1:]]
_NEAR_TWO = (
    f"WITH {CUSTOMERS_WITH_NEAR_COPIES}, {_RECORDS}, marked AS (SELECT *, {_MATCHED} AS matched FROM records) "
    + " UNION ALL ".join(_left_out(s, ", COUNT(*) AS n_new") for s in _ONE)
    + " UNION ALL "
    + " UNION ALL ".join(
        _left_out(s, ", COUNT(*) FILTER (WHERE NOT matched) AS n_new") + " AND COUNT(*) FILTER (WHERE NOT matched) > 0"
        for s in _TWO
    )
)


@query(_NEAR_TWO)
def near_duplicate_groups_two_changes(spark, sf):
    return U.near_duplicate_groups(customers_with_near_copies(spark, sf), RECORD, anchors=["c_name"], max_changed=2)


_NO_ANCHOR = f"WITH {CUSTOMERS_WITH_NEAR_COPIES}, {_RECORDS}, marked AS (SELECT * FROM records)" + " UNION ALL ".join(
    _left_out((c,), ", COUNT(*) AS n_new") for c in RECORD
)


@query(_NO_ANCHOR)
def near_duplicate_groups_unanchored(spark, sf):
    return U.near_duplicate_groups(customers_with_near_copies(spark, sf), RECORD)
