"""Audit of a table of SQL texts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..functions import sqltext as Q, vocabulary as V


def flag_statements(log: DataFrame, sql: str = "query") -> DataFrame:
    return log.withColumn("is_read_only", Q.is_read_only(sql)).withColumn("is_destructive", Q.is_destructive(sql))


def distinct_queries(log: DataFrame, order: str, sql: str = "query") -> DataFrame:
    """(query_key, first_query, first_seen, n_uses) of the safe statements. The
    earliest spelling is found by a minimum, not by sorting each group."""
    safe = log.where(Q.is_read_only(sql) & ~Q.is_destructive(sql)).select(order, Q.statement(sql).alias("text"))
    uses = safe.select(Q.statement_key("text").alias("query_key"), F.struct(order, "text").alias("use"))
    return uses.groupBy("query_key").agg(F.min("use").alias("first"), F.count(F.lit(1)).alias("n_uses")).select(
        "query_key", F.col("first.text").alias("first_query"), F.col(f"first.{order}").alias("first_seen"), "n_uses"
    )


def repeat_ratio(log: DataFrame, sql: str = "query", max_ratio: float = V.MAX_REPEAT_RATIO) -> DataFrame:
    """Share of statements that repeat an earlier one, over the whole log."""
    counts = log.groupBy(Q.query_key(sql).alias("query_key")).agg(F.count(F.lit(1)).alias("n"))
    ratio = 1.0 - F.count(F.lit(1)).cast("double") / F.sum("n").cast("double")
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_queries"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.coalesce(ratio, F.lit(0.0)).alias("repeat_ratio"),
        F.coalesce(ratio > max_ratio, F.lit(False)).alias("is_excessive"),
    )


def with_referenced_tables(log: DataFrame, sql: str = "query", name: str = "tables") -> DataFrame:
    return log.withColumn(name, Q.referenced_tables(sql))


def table_uses(log: DataFrame, sql: str = "query") -> DataFrame:
    """(table_name, n_queries), each table once per query."""
    return (
        log.select(F.explode(Q.referenced_tables(sql)).alias("table_name"))
        .groupBy("table_name").agg(F.count(F.lit(1)).alias("n_queries"))
    )


def unknown_tables(log: DataFrame, allowed: Iterable[str], sql: str = "query") -> DataFrame:
    """Log rows plus ``unknown_table``, one row per table outside the allowed
    schema (a short list of names). Row-wise: no join, no shuffle."""
    known = F.array(*(F.lit(a.lower()) for a in allowed)).cast("array<string>")
    return log.withColumn("unknown_table", F.explode(F.array_except(Q.referenced_tables(sql), known)))


def with_features(log: DataFrame, sql: str = "query") -> DataFrame:
    return log.select("*", *(Q.feature(sql, name).alias(name) for name in V.QUERY_FEATURES))
