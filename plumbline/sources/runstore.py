"""A history of runs that keeps the best of each task, one partition per task.

Adding runs reads and replaces only the partitions of their tasks. A run that is there
already is not added again, so a job that is run twice leaves the store as it was; a
failed write leaves it too, since new files take the place of old ones when all are written.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.history import top_runs
from ..session import durable

KEPT = 500
#: Without the task, which is the partition.
_COLUMNS = ("seed", "score", "query_plan", "evidence")
SCHEMA = "seed bigint, score double, query_plan array<string>, evidence map<string,string>, task_id int"


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All kept runs; none while nothing was added."""
    try:
        return spark.read.schema(SCHEMA).parquet(folder).select("task_id", *_COLUMNS)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA).select("task_id", *_COLUMNS)


def _distinct(runs: DataFrame) -> DataFrame:
    """Equal runs once. Maps cannot be compared: their sorted entries stand for them."""
    entries = F.array_sort(F.map_entries("evidence")).alias("entries")
    once = runs.select("task_id", "seed", "score", "query_plan", entries).distinct()
    return once.select("task_id", "seed", "score", "query_plan", F.map_from_entries("entries").alias("evidence"))


def add(runs: DataFrame, folder: str, keep: int = KEPT) -> None:
    """Adds runs (task_id, seed, score and, if there, query_plan and evidence), then keeps the
    ``keep`` best of each task that got one: highest score, earlier seed first among equals.
    Runs without a task are refused. Of runs that differ in nothing but plan or evidence all count."""
    spark = runs.sparkSession
    given = {"query_plan": "array<string>", "evidence": "map<string,string>"}
    new = durable(runs.select(
        F.coalesce(F.col("task_id").cast("int"), F.raise_error(F.lit("a run needs a task"))).alias("task_id"), F.col("seed").cast("bigint").alias("seed"),
        F.col("score").cast("double").alias("score"),
        *((F.col(c) if c in runs.columns else F.lit(None)).cast(t).alias(c) for c, t in given.items()),
    ))
    tasks = new.select("task_id").distinct()
    before = read(spark, folder).join(tasks, "task_id", "left_semi").select("task_id", *_COLUMNS)  # pruned to the tasks' partitions
    kept = durable(top_runs(_distinct(before.unionByName(new)), keep).drop("run_rank"))
    kept.repartition("task_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task_id").parquet(folder)
