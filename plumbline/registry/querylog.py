"""A query log: one statement per order, spelled in ways real logs are."""

from pyspark.sql import functions as F

from ..functions.vocabulary import QUERY_FEATURES
from ..operators import querylog as Q
from ..sources.catalog import table
from . import query

# one expression, valid in both engines
LOG_TEXT = r"""CASE o_orderkey % 12
  WHEN 0 THEN 'SELECT COUNT(*) FROM orders WHERE o_custkey = ' || CAST(o_custkey AS STRING)
  WHEN 1 THEN '  select   count(*) from ORDERS where o_custkey = ' || CAST(o_custkey AS STRING) || ';'
  WHEN 2 THEN 'WITH t AS (SELECT AVG(o_totalprice) AS a FROM main.orders) SELECT a FROM t LIMIT 5'
  WHEN 3 THEN 'DELETE FROM orders WHERE o_orderkey = ' || CAST(o_orderkey AS STRING)
  WHEN 4 THEN 'SELECT c.c_name FROM customer c LEFT JOIN db.sales.Orders o ON c.c_custkey = o.o_custkey'
  WHEN 5 THEN 'SELECT last_update FROM audit_log WHERE day = ' || CAST(o_custkey % 30 AS STRING)
  WHEN 6 THEN 'update orders set o_totalprice = 0'
  WHEN 7 THEN ''
  WHEN 8 THEN 'SELECT try_cast(x AS DOUBLE) FROM staging GROUP BY x HAVING COUNT(*) > 1 LIMIT 10;;'
  WHEN 9 THEN 'EXPLAIN SELECT 1'
  WHEN 10 THEN 'SELECT DISTINCT o_orderstatus FROM orders JOIN customer ON true JOIN orders ON true'
  ELSE NULL END"""
LOG = f"query_log AS (SELECT o_orderkey AS id, {LOG_TEXT} AS query FROM orders)"
ALLOWED = ("customer", "orders", "lineitem")

_STATEMENT = r"regexp_replace(regexp_replace(COALESCE(query, ''), '^\s+|\s+$', '', 'g'), ';+$', '')"
_KEY = rf"lower(regexp_replace({_STATEMENT}, '\s+', ' ', 'g'))"
_READ_ONLY = r"regexp_matches(query, '^\s*(select|with)\b', 'i')"
_DESTRUCTIVE = r"regexp_matches(query, '\b(drop|truncate|delete|insert|update|alter|create)\b', 'i')"
_TABLES = r"""list_sort(list_distinct(list_transform(
  regexp_extract_all(query, '\b(?:from|join)\s+([a-zA-Z_][\w\.]*)', 1, 'i'),
  lambda n: lower(split_part(n, '.', -1)))))"""


def _log(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.expr(LOG_TEXT).alias("query"))


@query(f"WITH {LOG} SELECT id, query, {_READ_ONLY} AS is_read_only, {_DESTRUCTIVE} AS is_destructive FROM query_log")
def statement_flags(spark, sf):
    return Q.flag_statements(_log(spark, sf))


@query(f"""WITH {LOG}, safe AS (
  SELECT id, {_STATEMENT} AS text, {_KEY} AS query_key FROM query_log
  WHERE {_STATEMENT} <> '' AND {_READ_ONLY} AND NOT {_DESTRUCTIVE})
SELECT query_key, arg_min(text, id) AS first_query, MIN(id) AS first_seen, COUNT(*) AS n_uses FROM safe GROUP BY 1""")
def distinct_queries(spark, sf):
    return Q.distinct_queries(_log(spark, sf), "id")


@query(f"""WITH {LOG}
SELECT COUNT(*) AS n_queries, COUNT(DISTINCT {_KEY}) AS n_distinct,
       ROUND(1.0 - CAST(COUNT(DISTINCT {_KEY}) AS DOUBLE) / COUNT(*), 9) AS repeat_ratio,
       1.0 - CAST(COUNT(DISTINCT {_KEY}) AS DOUBLE) / COUNT(*) > 0.20 AS is_excessive FROM query_log""")
def repeat_ratio(spark, sf):
    return Q.repeat_ratio(_log(spark, sf)).withColumn("repeat_ratio", F.round("repeat_ratio", 9))


@query(f"WITH {LOG} SELECT id, array_to_string({_TABLES}, ',') AS tables FROM query_log")
def referenced_tables(spark, sf):
    return Q.with_referenced_tables(_log(spark, sf)).select(
        "id", F.when(F.col("tables").isNotNull(), F.array_join("tables", ",")).alias("tables")
    )


@query(f"""WITH {LOG} SELECT t AS table_name, COUNT(*) AS n_queries
FROM (SELECT unnest({_TABLES}) AS t FROM query_log) x GROUP BY 1""")
def table_uses(spark, sf):
    return Q.table_uses(_log(spark, sf))


@query(f"""WITH {LOG} SELECT id, t AS unknown_table FROM (SELECT id, unnest({_TABLES}) AS t FROM query_log) x
WHERE t NOT IN ('customer', 'orders', 'lineitem')""")
def unknown_tables(spark, sf):
    return Q.unknown_tables(_log(spark, sf), ALLOWED).select("id", "unknown_table")


_FEATURES = ", ".join(
    "(" + " OR ".join(f"contains(lower(COALESCE(query, '')), '{w}')" for w in words) + f") AS {name}"
    for name, words in QUERY_FEATURES.items()
)


@query(f"WITH {LOG} SELECT id, {_FEATURES} FROM query_log")
def query_features(spark, sf):
    return Q.with_features(_log(spark, sf)).drop("query")
