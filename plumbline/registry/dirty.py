"""The driver's tables are clean, so queries put faults into them first: whole
tables, faults on the keys a predicate picks, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import vocabulary as V
from ..operators import inject as I
from ..sources.catalog import table

SPLIT = "2024-01-16"
NEW_CATEGORIES = ("crypto", "NFT")
NUMBER, ISO = V.NUMBER_PATTERN, V.ISO_DATE_PATTERN
TOKENS_SQL = "(" + ",".join(f"'{t}'" for t in V.NULL_TOKENS) + ")"


def _list(values) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


# --- customer: nulls and disguised nulls ---------------------------------
def customers_with_nulls(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer")
    df = I.null_out(df, "c_mktsegment", I.pick_rows("c_custkey", 97, 3))
    df = I.null_out(df, "c_nationkey", I.pick_rows("c_custkey", 131, 8))
    return I.disguise(df, "c_mktsegment", I.pick_rows("c_custkey", 89, 5), "c_custkey")


CUSTOMERS_WITH_NULLS = f"""
customers AS (
  SELECT c_custkey, c_name,
         CASE WHEN c_custkey % 131 = 8 THEN NULL ELSE c_nationkey END AS c_nationkey, c_acctbal,
         CASE WHEN c_custkey % 89 = 5 THEN ({_list(V.DISGUISES)})[c_custkey % 7 + 1]
              WHEN c_custkey % 97 = 3 THEN NULL ELSE c_mktsegment END AS c_mktsegment
  FROM customer)"""


# --- customer: copies ------------------------------------------------------
RECORD = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def customers_with_copies(spark: SparkSession, sf: str) -> DataFrame:
    return I.append_copies(table(spark, sf, "customer"), I.pick_rows("c_custkey", 50, 1))


CUSTOMERS_WITH_COPIES = """
customers AS (
  SELECT * FROM customer UNION ALL SELECT * FROM customer WHERE c_custkey % 50 = 1)"""


def customers_with_near_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Exact copies, copies with another nation, and copies with another nation and balance."""
    return with_near_copies(table(spark, sf, "customer"))


def with_near_copies(customers: DataFrame) -> DataFrame:
    other = F.pmod(F.col("c_nationkey") + 1, F.lit(25))
    return I.append_variants(
        customers,
        (I.pick_rows("c_custkey", 50, 1), {}),
        (I.pick_rows("c_custkey", 75, 2), {"c_nationkey": other}),
        (I.pick_rows("c_custkey", 120, 9), {"c_nationkey": other, "c_acctbal": F.col("c_acctbal") + 1}),
    )


def dirty_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Nulls, disguised nulls, copies and near copies in one table."""
    return with_near_copies(customers_with_nulls(spark, sf))


CUSTOMERS_WITH_NEAR_COPIES = """
customers AS (
  SELECT * FROM customer
  UNION ALL SELECT * FROM customer WHERE c_custkey % 50 = 1
  UNION ALL SELECT c_custkey, c_name, (c_nationkey + 1) % 25, c_acctbal, c_mktsegment
            FROM customer WHERE c_custkey % 75 = 2
  UNION ALL SELECT c_custkey, c_name, (c_nationkey + 1) % 25, c_acctbal + 1, c_mktsegment
            FROM customer WHERE c_custkey % 120 = 9)"""


DIRTY_CUSTOMERS = CUSTOMERS_WITH_NULLS.replace("customers AS", "nulled AS") + "," + CUSTOMERS_WITH_NEAR_COPIES.replace("FROM customer", "FROM nulled")


# --- orders: numbers and dates as text -------------------------------------
def orders_as_text(spark: SparkSession, sf: str) -> DataFrame:
    df = I.as_currency_text(table(spark, sf, "orders"), "o_totalprice")
    df = I.spoil_numbers(df, "o_totalprice", I.pick_rows("o_orderkey", 101, 7), "o_orderkey")
    df = I.null_out(df, "o_totalprice", I.pick_rows("o_orderkey", 499, 12))
    df = df.withColumn("quantity", F.pmod("o_custkey", F.lit(19)) + 1)
    df = I.negate(df, "quantity", I.pick_rows("o_orderkey", 61, 2))
    return I.as_text_date(df, "o_orderdate")


ORDERS_AS_TEXT = f"""
dirty_orders AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderkey % 499 = 12 THEN NULL
              WHEN o_orderkey % 101 = 7 THEN ({_list(V.UNPARSEABLE_MARKERS)})[o_orderkey % 4 + 1]
              ELSE '$' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS o_totalprice,
         strftime(o_orderdate, '%b %d %Y') AS o_orderdate, o_orderpriority,
         (o_custkey % 19 + 1) * CASE WHEN o_orderkey % 61 = 2 THEN -1 ELSE 1 END AS quantity
  FROM orders)"""

PARSED = f"""CASE WHEN regexp_full_match(replace(o_totalprice, '$', ''), '{NUMBER}')
              THEN try_cast(trim(replace(o_totalprice, '$', '')) AS DOUBLE) END"""
RAW = f"CASE WHEN regexp_full_match(o_totalprice, '{NUMBER}') THEN try_cast(trim(o_totalprice) AS DOUBLE) END"
ISO_DATE = f"CASE WHEN regexp_full_match(o_orderdate, '{ISO}') THEN try_cast(o_orderdate AS DATE) END"
TEXT_DATE = "CAST(try_strptime(o_orderdate, '%b %d %Y') AS DATE)"


# --- events: two snapshots ---------------------------------------------------
def snapshots(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf, "events")
    later = F.col("ts") >= F.lit(SPLIT).cast("timestamp_ntz")
    current = I.scale_measure(events.where(later), "value", 1.5)
    current = I.add_categories(current, "event_type", I.pick_rows("event_id", 20, 0), "event_id", NEW_CATEGORIES)
    current = I.null_out(current, "event_type", I.pick_rows("event_id", 33, 1))
    current = I.shift_ids(current, "user_id", I.pick_rows("event_id", 7, 0), 100000)
    return events.where(~later), current


SNAPSHOTS = f"""
base AS (SELECT * FROM events WHERE ts < TIMESTAMP '{SPLIT} 00:00:00'),
cur AS (
  SELECT event_id, ts,
         CASE WHEN event_id % 7 = 0 THEN user_id + 100000 ELSE user_id END AS user_id,
         CASE WHEN event_id % 33 = 1 THEN NULL
              WHEN event_id % 20 = 0 THEN ({_list(NEW_CATEGORIES)})[event_id % 2 + 1]
              ELSE event_type END AS event_type,
         value * 1.5 AS value, props
  FROM events WHERE ts >= TIMESTAMP '{SPLIT} 00:00:00')"""


# --- orders: foreign keys and totals -----------------------------------------
def orders_with_orphans(spark: SparkSession, sf: str) -> DataFrame:
    df = I.orphan_keys(table(spark, sf, "orders"), "o_custkey", I.pick_rows("o_orderkey", 211, 4), 1_000_000)
    return I.null_out(df, "o_custkey", I.pick_rows("o_orderkey", 307, 9))


ORDERS_WITH_ORPHANS = """
dirty_orders AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 307 = 9 THEN NULL
              WHEN o_orderkey % 211 = 4 THEN o_custkey + 1000000 ELSE o_custkey END AS o_custkey,
         o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
  FROM orders)"""


def orders_with_line_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals built from the lines, then some inflated: the truth is known."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    sums = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_extendedprice").alias("o_totalprice")
    )
    df = orders.drop("o_totalprice").join(sums, "o_orderkey", "left")
    return I.inflate_totals(df, "o_totalprice", I.pick_rows("o_orderkey", 97, 0), 1.5)


ORDERS_WITH_LINE_TOTALS = """
built AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_orderdate, o.o_orderpriority,
         CASE WHEN o.o_orderkey % 97 = 0 THEN s.total * 1.5 ELSE s.total END AS o_totalprice
  FROM orders o LEFT JOIN (SELECT l_orderkey, SUM(l_extendedprice) AS total FROM lineitem GROUP BY 1) s
    ON o.o_orderkey = s.l_orderkey)"""
