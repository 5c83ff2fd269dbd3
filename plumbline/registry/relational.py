"""Checks between orders, customer and lineitem."""

from pyspark.sql import functions as F

from ..operators import inject as I, relational as R
from ..sources.catalog import table
from . import query
from .dirty import ORDERS_WITH_LINE_TOTALS, ORDERS_WITH_ORPHANS, orders_with_line_totals, orders_with_orphans

_ORPHAN_JOIN = "FROM dirty_orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_custkey IS NULL"


@query(f"WITH {ORDERS_WITH_ORPHANS} SELECT COUNT(*) AS orphan_count {_ORPHAN_JOIN}")
def orphan_count(spark, sf):
    return R.orphan_count(orders_with_orphans(spark, sf), "o_custkey", table(spark, sf, "customer"), "c_custkey")


@query(f"WITH {ORDERS_WITH_ORPHANS} SELECT o.o_orderkey, o.o_custkey, o.o_totalprice {_ORPHAN_JOIN}")
def orphan_rows(spark, sf):
    rows = R.orphan_rows(orders_with_orphans(spark, sf), "o_custkey", table(spark, sf, "customer"), "c_custkey")
    return rows.select("o_orderkey", "o_custkey", "o_totalprice")


@query("""SELECT COUNT(*) AS orphan_count FROM labels l LEFT JOIN documents d
  ON CASE WHEN l.doc_id % 40 = 1 THEN l.doc_id + 1000000000000 ELSE l.doc_id END = d.doc_id
WHERE d.doc_id IS NULL""")
def orphan_labels(spark, sf):
    labels = I.orphan_keys(table(spark, sf, "labels"), "doc_id", I.pick_rows("doc_id", 40, 1), 1_000_000_000_000)
    return R.orphan_count(labels, "doc_id", table(spark, sf, "documents"), "doc_id")


def _lines_with_orders(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey)


_TEMPORAL = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate"


@query(f"SELECT COUNT(*) AS temporal_count {_TEMPORAL}")
def temporal_violation_count(spark, sf):
    return R.temporal_violation_count(_lines_with_orders(spark, sf), "o_orderdate", "l_shipdate")


@query(f"SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS VARCHAR) AS l_shipdate, CAST(o_orderdate AS VARCHAR) AS o_orderdate {_TEMPORAL}")
def temporal_violation_rows(spark, sf):
    return R.temporal_violations(_lines_with_orders(spark, sf), "o_orderdate", "l_shipdate").select(
        "l_orderkey", "l_linenumber", *(F.col(c).cast("string").alias(c) for c in ("l_shipdate", "o_orderdate"))
    )


def _mismatch(parents, amount, select="COUNT(*) AS aggregate_count"):
    return f"""SELECT {select} FROM (
  SELECT o.o_orderkey, o.o_totalprice, SUM({amount}) AS s FROM {parents} o JOIN lineitem li
    ON o.o_orderkey = li.l_orderkey
  GROUP BY o.o_orderkey, o.o_totalprice HAVING abs(o.o_totalprice - SUM({amount})) > 1e-6) x"""


@query(_mismatch("orders", "l_extendedprice"))
def aggregate_mismatch_count(spark, sf):
    return R.aggregate_mismatch_count(
        table(spark, sf, "orders"), "o_orderkey", "o_totalprice",
        table(spark, sf, "lineitem"), "l_orderkey", "l_extendedprice",
    )


@query(f"WITH {ORDERS_WITH_LINE_TOTALS} "
       + _mismatch("built", "l_extendedprice",
                   "o_orderkey, ROUND(o_totalprice, 4) AS o_totalprice, ROUND(s, 4) AS line_total"))
def aggregate_mismatch_rows(spark, sf):
    rows = R.aggregate_mismatches(
        orders_with_line_totals(spark, sf), "o_orderkey", "o_totalprice",
        table(spark, sf, "lineitem"), "l_orderkey", "l_extendedprice",
    )
    return rows.select("o_orderkey", *(F.round(c, 4).alias(c) for c in ("o_totalprice", "line_total")))


@query(_mismatch("orders", "l_extendedprice * (1 - l_discount) * (1 + l_tax)"))
def expression_mismatch_count(spark, sf):
    charge = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return R.aggregate_mismatch_count(
        table(spark, sf, "orders"), "o_orderkey", "o_totalprice", table(spark, sf, "lineitem"), "l_orderkey", charge,
        parent_is_unique=True,
    )


@query("""SELECT COUNT(*) AS childless_count FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""")
def childless_count(spark, sf):
    return R.childless_count(table(spark, sf, "orders"), "o_orderkey", table(spark, sf, "lineitem"), "l_orderkey")


@query("""SELECT o_orderkey, o_totalprice FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)""")
def childless_rows(spark, sf):
    return R.childless_parents(
        table(spark, sf, "orders"), "o_orderkey", table(spark, sf, "lineitem"), "l_orderkey"
    ).select("o_orderkey", "o_totalprice")


@query("""SELECT COUNT(*) AS aggregate_count FROM (
  SELECT o.o_orderkey FROM orders o LEFT JOIN lineitem li ON o.o_orderkey = li.l_orderkey
  GROUP BY o.o_orderkey, o.o_totalprice
  HAVING abs(o.o_totalprice - COALESCE(SUM(l_extendedprice), 0)) > 1e-6) x""")
def aggregate_mismatch_with_childless(spark, sf):
    return R.aggregate_mismatch_count(
        table(spark, sf, "orders"), "o_orderkey", "o_totalprice",
        table(spark, sf, "lineitem"), "l_orderkey", "l_extendedprice", include_childless=True,
    )
