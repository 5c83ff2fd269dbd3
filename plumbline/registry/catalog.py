"""Registering, guarding, listing and counting tables."""

from pyspark.sql import functions as F

from ..sources import catalog as S
from . import query

TPCH = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


@query("""
SELECT table_name, column_name,
       CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string'
                      WHEN 'DOUBLE' THEN 'double' WHEN 'TIMESTAMP' THEN 'timestamp_ntz'
                      ELSE lower(data_type) END AS column_type,
       CAST(n_rows AS BIGINT) AS n_rows
FROM information_schema.columns JOIN (
  SELECT 'region' AS t, COUNT(*) AS n_rows FROM region UNION ALL SELECT 'nation', COUNT(*) FROM nation
  UNION ALL SELECT 'customer', COUNT(*) FROM customer UNION ALL SELECT 'supplier', COUNT(*) FROM supplier
  UNION ALL SELECT 'part', COUNT(*) FROM part UNION ALL SELECT 'orders', COUNT(*) FROM orders
  UNION ALL SELECT 'lineitem', COUNT(*) FROM lineitem) c ON table_name = c.t
""")
def table_observation(spark, sf):
    return S.observe(S.load(spark, sf, TPCH))


@query("""
SELECT 'region' AS table_name, COUNT(*) AS n_rows FROM region UNION ALL SELECT 'nation', COUNT(*) FROM nation
UNION ALL SELECT 'customer', COUNT(*) FROM customer UNION ALL SELECT 'supplier', COUNT(*) FROM supplier
UNION ALL SELECT 'part', COUNT(*) FROM part UNION ALL SELECT 'orders', COUNT(*) FROM orders
UNION ALL SELECT 'lineitem', COUNT(*) FROM lineitem UNION ALL SELECT 'events', COUNT(*) FROM events
UNION ALL SELECT 'documents', COUNT(*) FROM documents UNION ALL SELECT 'conversations', COUNT(*) FROM conversations
""")
def table_row_counts(spark, sf):
    return S.row_counts(S.load(spark, sf, (*TPCH, "events", "documents", "conversations")))


AD_HOC = """
WITH spend AS (
  SELECT o_custkey, COUNT(*) AS n_orders, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total
  FROM orders GROUP BY o_custkey)
SELECT c.c_mktsegment, COUNT(*) AS n_customers, CAST(SUM(s.n_orders) AS BIGINT) AS n_orders,
       CAST(SUM(s.total) AS DOUBLE) AS total_spend
FROM customer c JOIN spend s ON c.c_custkey = s.o_custkey GROUP BY c.c_mktsegment
"""


@query(AD_HOC)
def guarded_sql(spark, sf):
    tables = S.load(spark, sf, ("customer", "orders"))
    S.register(spark, tables)
    return S.run_sql(spark, AD_HOC, tables)


WHOLE_RESULT = "SELECT o_orderkey, o_custkey, 'U' <> o_orderstatus AS kept FROM orders WHERE o_totalprice IS DISTINCT FROM 0"


@query(WHOLE_RESULT)
def guarded_sql_whole_result(spark, sf):
    tables = S.load(spark, sf, ("orders",))
    S.register(spark, tables)
    return S.run_sql(spark, WHOLE_RESULT, tables)


@query("""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50
""")
def result_preview(spark, sf):
    orders = S.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return S.preview(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], 50)
