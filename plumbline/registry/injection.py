"""Every fault injector over its whole table, next to the same fault in SQL."""

from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..operators import inject as I
from ..sources.catalog import table
from . import query
from .dirty import (
    CUSTOMERS_WITH_COPIES, CUSTOMERS_WITH_NEAR_COPIES, CUSTOMERS_WITH_NULLS, ORDERS_AS_TEXT, SNAPSHOTS, _list,
    customers_with_copies, customers_with_near_copies, customers_with_nulls, orders_as_text, snapshots,
)


@query("SELECT c_custkey, CASE WHEN c_custkey % 97 = 3 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
def inject_nulls(spark, sf):
    df = I.null_out(table(spark, sf, "customer"), "c_mktsegment", I.pick_rows("c_custkey", 97, 3))
    return df.select("c_custkey", "c_mktsegment")


@query(f"WITH {CUSTOMERS_WITH_NULLS} SELECT c_custkey, c_nationkey, c_mktsegment FROM customers")
def inject_disguised_nulls(spark, sf):
    return customers_with_nulls(spark, sf).select("c_custkey", "c_nationkey", "c_mktsegment")


@query(f"WITH {CUSTOMERS_WITH_COPIES} SELECT * FROM customers")
def inject_copies(spark, sf):
    return customers_with_copies(spark, sf)


@query(f"WITH {CUSTOMERS_WITH_NEAR_COPIES} SELECT c_custkey, c_nationkey, ROUND(c_acctbal, 2) AS c_acctbal FROM customers")
def inject_near_copies(spark, sf):
    return customers_with_near_copies(spark, sf).select(
        "c_custkey", "c_nationkey", F.round("c_acctbal", 2).alias("c_acctbal")
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN l_partkey % 61 = 2 THEN -abs(l_quantity) ELSE l_quantity END AS l_quantity FROM lineitem""")
def inject_negatives(spark, sf):
    df = I.negate(table(spark, sf, "lineitem"), "l_quantity", I.pick_rows("l_partkey", 61, 2))
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(f"WITH {ORDERS_AS_TEXT} SELECT o_orderkey, o_totalprice, o_orderdate FROM dirty_orders")
def inject_text_numbers_and_dates(spark, sf):
    return orders_as_text(spark, sf).select("o_orderkey", "o_totalprice", "o_orderdate")


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 7 THEN ({_list(V.UNPARSEABLE_MARKERS)})[o_orderkey % 4 + 1]
  ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def inject_unparseable_markers(spark, sf):
    df = I.spoil_numbers(table(spark, sf, "orders"), "o_orderpriority", I.pick_rows("o_orderkey", 101, 7), "o_orderkey")
    return df.select("o_orderkey", "o_orderpriority")


@query(f"WITH {SNAPSHOTS} SELECT event_id, user_id, event_type, ROUND(value, 4) AS value FROM cur")
def inject_snapshot_drift(spark, sf):
    return snapshots(spark, sf)[1].select("event_id", "user_id", "event_type", F.round("value", 4).alias("value"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 211 = 4 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey
FROM orders""")
def inject_orphans(spark, sf):
    df = I.orphan_keys(table(spark, sf, "orders"), "o_custkey", I.pick_rows("o_orderkey", 211, 4), 1_000_000)
    return df.select("o_orderkey", "o_custkey")


def _late(spark, sf):
    ahead = F.col("o_orderdate") + F.make_dt_interval(days=F.lit(3))
    df = table(spark, sf, "orders").withColumn("ship_date", ahead)
    return I.end_before_start(df, "o_orderdate", "ship_date", I.pick_rows("o_orderkey", 71, 5), days=2)


@query("""SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 71 = 5 THEN o_orderdate - INTERVAL 2 DAY
  ELSE o_orderdate + INTERVAL 3 DAY END AS VARCHAR) AS ship_date FROM orders""")
def inject_reversed_dates(spark, sf):
    return _late(spark, sf).select("o_orderkey", F.col("ship_date").cast("string").alias("ship_date"))


@query("""SELECT o_orderkey, ROUND(CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice * 1.5 ELSE o_totalprice END, 4)
  AS o_totalprice FROM orders""")
def inject_inflated_totals(spark, sf):
    df = I.inflate_totals(table(spark, sf, "orders"), "o_totalprice", I.pick_rows("o_orderkey", 97, 0), 1.5)
    return df.select("o_orderkey", F.round("o_totalprice", 4).alias("o_totalprice"))


@query("""SELECT 'customer' AS table_name, COUNT(*) FILTER (WHERE c_custkey % 97 = 3) AS n_injected FROM customer
UNION ALL SELECT 'orders', COUNT(*) FILTER (WHERE o_orderkey % 71 = 5) FROM orders""")
def injected_truth(spark, sf):
    first = I.truth(table(spark, sf, "customer"), I.pick_rows("c_custkey", 97, 3))
    second = I.truth(table(spark, sf, "orders"), I.pick_rows("o_orderkey", 71, 5))
    return first.select(F.lit("customer").alias("table_name"), "n_injected").unionByName(
        second.select(F.lit("orders").alias("table_name"), "n_injected")
    )


@query("SELECT COUNT(*) FILTER (WHERE o_orderkey % 71 = 5) AS temporal_count FROM orders")
def injected_reversals_found(spark, sf):
    from ..operators.relational import temporal_violation_count

    return temporal_violation_count(_late(spark, sf), "o_orderdate", "ship_date")
