"""Writing findings and reports, and reading run history back."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

RUN_SCHEMA = (
    "task_id int, seed int, score double, query_plan array<string>, evidence map<string,string>"
)


def write_findings(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                   partition_by: Iterable[str] = ()) -> None:
    """One directory of files written by the executors."""
    df.write.format(fmt).mode(mode).partitionBy(*partition_by).save(path)


def as_report_json(df: DataFrame, keys: Iterable[str], name: str = "report") -> DataFrame:
    """Fold every column but ``keys`` into one JSON text column."""
    keys = list(keys)
    body = F.struct(*(F.col(c) for c in df.columns if c not in keys))
    return df.select(*keys, F.to_json(body).alias(name))


def write_runs(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append runs to a JSON-lines history."""
    df.write.mode(mode).json(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_SCHEMA).json(path)
