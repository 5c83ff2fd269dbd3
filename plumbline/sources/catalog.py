"""Loading, registering, listing and querying named tables."""

from __future__ import annotations

import os
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .sqlguard import RefusedStatement, guard  # noqa: F401 (part of this module's interface)

Tables = Mapping[str, DataFrame]


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(directory, f"{name}.parquet"))


def load(spark: SparkSession, directory: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {name: table(spark, directory, name) for name in names}


def from_pandas(spark: SparkSession, frame, schema: T.StructType | str | None = None) -> DataFrame:
    """A DataFrame in which missing values are NULL.

    pandas marks a missing number with NaN, which Spark keeps as a value that
    ``IS NULL`` does not see; float columns are mapped back here.
    """
    df = spark.createDataFrame(frame, schema) if schema is not None else spark.createDataFrame(frame)
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    return df.select(
        *(F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns)
    )


def register(spark: SparkSession, tables: Tables) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, text: str, tables: Iterable[str] | None = None) -> DataFrame:
    """The whole result of read-only SQL. With ``tables`` only those names (and the
    text's own WITH names) may be read; see ``sqlguard.guard``. To see a part of a result,
    use ``preview``, which asks for an order."""
    return spark.sql(guard(spark, text, tables))


def preview(df: DataFrame, order_by: Iterable[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows in a stated order (a bare limit may differ between runs)."""
    return df.orderBy(*order_by).limit(n)


def schemas(tables: Tables) -> DataFrame:
    """One row per column: (table_name, column_name, column_type). Only schema
    metadata passes through the driver."""
    rows = [(name, c, t) for name, df in tables.items() for c, t in df.dtypes]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table_name string, column_name string, column_type string")


def row_counts(tables: Tables) -> DataFrame:
    """(table_name, n_rows); each count reads no column data."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def observe(tables: Tables) -> DataFrame:
    """Schema listing and row counts of a table set in one frame."""
    # both sides have one row per column / table of the set
    return schemas(tables).join(F.broadcast(row_counts(tables)), "table_name")
