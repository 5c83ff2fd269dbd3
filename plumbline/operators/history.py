"""Run history: the best runs and what they say about each check query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import vocabulary as V


def top_runs(runs: DataFrame, k: int = V.TOP_RUNS) -> DataFrame:
    """The ``k`` best runs of each task, earlier seed first among equals. Every
    task keeps only its own ``k`` per group before the shuffle (a rank limit is
    pushed below it), so a hot task id is no burden."""
    best_first = Window.partitionBy("task_id").orderBy(F.desc("score"), F.asc("seed"))
    return (
        runs.withColumn("run_rank", F.row_number().over(best_first))
        .where(F.col("run_rank") <= k)
    )


def keep_best_runs(runs: DataFrame, n: int, per_task: bool = True) -> DataFrame:
    """The ``n`` best runs of each task. ``per_task=False`` keeps ``n`` over all
    tasks, later tasks first, and so may leave tasks without a run."""
    if per_task:
        return top_runs(runs, n).drop("run_rank")
    return runs.orderBy(F.desc("task_id"), F.desc("score"), F.asc("seed")).limit(n)


def check_weights(runs: DataFrame, k: int = V.TOP_RUNS, queries: DataFrame | None = None) -> DataFrame:
    """(task_id, query, weight): how much the best runs favour a query, more so
    the earlier they ask it. With ``queries`` (task_id, query) exactly those
    pairs are returned, 0 for one that no top run used."""
    step = F.lit(V.RANK_WEIGHT_START) - F.lit(V.RANK_WEIGHT_STEP) * F.col("place")
    worth = F.greatest(F.lit(0.0), step) * F.greatest(F.lit(0.0), F.col("score"))
    weights = (
        top_runs(runs, k)
        .select("task_id", "score", F.posexplode("query_plan").alias("place", "query"))
        .groupBy("task_id", "query")
        .agg(F.sum(worth).alias("weight"))
    )
    if queries is None:
        return weights
    return queries.select("task_id", "query").distinct().join(weights, ["task_id", "query"], "left").select(
        "task_id", "query", F.coalesce("weight", F.lit(0.0)).alias("weight")
    )
