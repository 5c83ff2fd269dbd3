"""Types, formats and ranges."""

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import conformance as V
from ..sources.catalog import table
from . import query
from .dirty import ISO_DATE, ORDERS_AS_TEXT, PARSED, RAW, TEXT_DATE, orders_as_text

NOT_NUMBER = f"({PARSED}) IS NULL"
NEEDS_CLEANING = f"(({RAW}) IS NULL AND ({PARSED}) IS NOT NULL)"
NEEDS_REFORMAT = f"(({ISO_DATE}) IS NULL AND {TEXT_DATE} IS NOT NULL)"


@query("SELECT COUNT(*) FILTER (WHERE c_acctbal < 0) AS n_out_of_range FROM customer")
def negative_balances(spark, sf):
    return V.range_violations(table(spark, sf, "customer"), "c_acctbal", lo=0)


@query("SELECT COUNT(*) FILTER (WHERE l_quantity < 5 OR l_quantity > 45) AS n_out_of_range FROM lineitem")
def quantity_out_of_bounds(spark, sf):
    return V.range_violations(table(spark, sf, "lineitem"), "l_quantity", lo=5, hi=45)


@query(f"WITH {ORDERS_AS_TEXT} SELECT COUNT(*) FILTER (WHERE {NOT_NUMBER}) AS n_unparseable FROM dirty_orders")
def unparseable_numbers(spark, sf):
    return V.unparseable_count(orders_as_text(spark, sf), "o_totalprice")


@query(f"""WITH {ORDERS_AS_TEXT}
SELECT COUNT(*) FILTER (WHERE {NOT_NUMBER} AND o_totalprice IS NOT NULL) AS n_unparseable FROM dirty_orders""")
def unparseable_numbers_without_nulls(spark, sf):
    return V.unparseable_count(orders_as_text(spark, sf), "o_totalprice", count_nulls=False)


@query(f"WITH {ORDERS_AS_TEXT} SELECT COUNT(*) FILTER (WHERE {NEEDS_CLEANING}) AS n_type_violations FROM dirty_orders")
def type_violations(spark, sf):
    return V.type_violation_count(orders_as_text(spark, sf), "o_totalprice")


@query(f"""WITH {ORDERS_AS_TEXT}
SELECT COUNT(*) FILTER (WHERE {NEEDS_REFORMAT}) AS n_date_format_violations FROM dirty_orders""")
def date_format_violations(spark, sf):
    return V.date_format_violation_count(orders_as_text(spark, sf), "o_orderdate")


@query(f"WITH {ORDERS_AS_TEXT} SELECT o_orderkey, o_totalprice, {PARSED} AS o_totalprice_num FROM dirty_orders")
def parsed_numbers(spark, sf):
    return V.parse_numbers(orders_as_text(spark, sf), "o_totalprice", keep=["o_orderkey"])


@query(f"WITH {ORDERS_AS_TEXT} SELECT o_orderkey, o_orderdate, CAST({TEXT_DATE} AS VARCHAR) AS o_orderdate_date FROM dirty_orders")
def parsed_dates(spark, sf):
    parsed = V.parse_dates(orders_as_text(spark, sf), "o_orderdate", keep=["o_orderkey"])
    return parsed.withColumn("o_orderdate_date", F.col("o_orderdate_date").cast("string"))


@query(f"WITH {ORDERS_AS_TEXT} SELECT o_orderkey, o_totalprice FROM dirty_orders WHERE {NOT_NUMBER}")
def unparseable_rows(spark, sf):
    rows = V.violating_rows(orders_as_text(spark, sf), C.unparseable("o_totalprice"))
    return rows.select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0")
def negative_balance_rows(spark, sf):
    return V.violating_rows(table(spark, sf, "customer"), C.out_of_range("c_acctbal", 0)).select(
        "c_custkey", "c_acctbal"
    )


@query(f"""WITH {ORDERS_AS_TEXT}
SELECT 'unparseable' AS issue_type, COUNT(*) FILTER (WHERE {NOT_NUMBER}) AS n_bad,
       MIN(o_totalprice) FILTER (WHERE {NOT_NUMBER}) AS example FROM dirty_orders
UNION ALL
SELECT 'type_violation', COUNT(*) FILTER (WHERE {NEEDS_CLEANING}),
       MIN(o_totalprice) FILTER (WHERE {NEEDS_CLEANING}) FROM dirty_orders""")
def violation_examples(spark, sf):
    return V.violation_examples(orders_as_text(spark, sf), "o_totalprice", {
        "unparseable": C.unparseable("o_totalprice"),
        "type_violation": C.number_needs_cleaning("o_totalprice"),
    })
