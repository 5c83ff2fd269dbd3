"""Updating a table where it is, partition by partition.

The table is a folder of Parquet files, partitioned by some columns. An update finds the
partitions with a row to change, reads only these and replaces them by dynamic overwrite:
files of all other partitions are neither read again nor written. New files are staged and
take their places when all of them are written, so a failed update leaves the table as it was.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.repair import update


def open_table(spark: SparkSession, folder: str, partitioned_by: Iterable[str]) -> DataFrame:
    """The table with its partition columns as texts, just as the folders spell them: read as
    numbers, ``007`` and ``7`` would be one partition and be written to another folder."""
    partitioned_by = set(partitioned_by)
    found = spark.read.parquet(folder).schema
    if unknown := partitioned_by - set(found.names):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    fields = [T.StructField(f.name, T.StringType()) if f.name in partitioned_by else f for f in found.fields]
    return spark.read.schema(T.StructType(fields)).parquet(folder)


def update_in_place(spark: SparkSession, folder: str, partitioned_by: Iterable[str], assignments: Mapping[str, Column | str],
                    where: Column | str) -> int:
    """``UPDATE … SET … WHERE …`` on the files; the number of partitions that were replaced.

    Conditions see partition columns as texts. These cannot be assigned, since a row would
    change its partition. Without a row to change nothing is written. One short text per
    touched partition reaches the driver, which lists all files of the table anyway. Frames
    that were opened before list files that are gone: open the table again.
    """
    partitioned_by = list(partitioned_by)
    if fixed := set(assignments) & set(partitioned_by):
        raise ValueError(f"rows would change their partition: {sorted(fixed)}")
    rows = open_table(spark, folder, partitioned_by)
    partition = F.to_json(F.struct(*partitioned_by), {"ignoreNullFields": "false"})
    condition = F.expr(where) if isinstance(where, str) else where
    touched = [r["p"] for r in rows.where(condition).select(partition.alias("p")).distinct().collect()]
    if not touched:
        return 0
    changed = update(rows.where(partition.isin(touched)), assignments, condition)  # a filter on partitions alone: others are not listed
    changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitioned_by).parquet(folder)
    return len(touched)
