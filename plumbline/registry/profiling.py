"""Samples, distributions and summaries."""

from pyspark.sql import functions as F

from ..operators import profile as P
from ..sources.catalog import table
from . import query
from .dirty import ORDERS_AS_TEXT, orders_as_text


@query("SELECT * FROM customer ORDER BY c_custkey LIMIT 5")
def sample_rows(spark, sf):
    return P.sample_rows(table(spark, sf, "customer"), 5, ["c_custkey"])


@query("SELECT COUNT(*) AS total_rows FROM lineitem")
def row_count(spark, sf):
    return P.row_count(table(spark, sf, "lineitem"))


@query("SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY 1")
def value_distribution(spark, sf):
    return P.value_counts(table(spark, sf, "customer"), "c_mktsegment")


@query("SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY 1")
def status_distribution(spark, sf):
    return P.value_counts(table(spark, sf, "orders"), "o_orderstatus")


@query("SELECT event_type, ROUND(AVG(value), 6) AS mean_value FROM events GROUP BY 1")
def group_mean(spark, sf):
    means = P.group_mean(table(spark, sf, "events"), "event_type", "value")
    return means.withColumn("mean_value", F.round("mean_value", 6))


@query(f"WITH {ORDERS_AS_TEXT} SELECT o_totalprice, o_orderdate FROM dirty_orders ORDER BY o_orderkey LIMIT 10")
def projected_preview(spark, sf):
    return P.project_preview(orders_as_text(spark, sf), ["o_totalprice", "o_orderdate"], 10, ["o_orderkey"])


_SUMMARY = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, COUNT({c}) AS n_values, {'NULL' if exact else f'ROUND(SUM({c}), 2)'} AS sum_value, "
    f"{'NULL' if exact else f'ROUND(AVG({c}), 6)'} AS avg_value, CAST(MIN({c}) AS DOUBLE) AS min_value, CAST(MAX({c}) AS DOUBLE) AS max_value, "
    + ", ".join(f"CAST({f}({c}) AS VARCHAR) AS exact_{f.lower()}" if exact else f"CAST(NULL AS VARCHAR) AS exact_{f.lower()}" for f in ("SUM", "MIN", "MAX"))
    + " FROM summed"
    for c, exact in (("l_quantity", False), ("l_extendedprice", False), ("big_key", True), ("price", True))
)
_SUMMED = """summed AS (SELECT l_quantity, l_extendedprice, 9007199254740993 + l_orderkey AS big_key,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem)"""


@query(f"WITH {_SUMMED} {_SUMMARY}")
def column_summary(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_quantity", "l_extendedprice", (F.lit(9007199254740993) + F.col("l_orderkey")).alias("big_key"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
    )
    summary = P.column_summary(lines, ["l_quantity", "l_extendedprice", "big_key", "price"])
    # sums of large numbers as doubles depend on their order: shown where there is no exact sum
    return summary.withColumns({c: F.when(F.col("exact_sum").isNull(), F.round(c, n)) for c, n in (("sum_value", 2), ("avg_value", 6))})
