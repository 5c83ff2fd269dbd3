"""Run history: one run per order."""

import uuid

from pyspark.sql import DataFrame, functions as F

from ..operators import history as H
from ..session import ensure_checkpoint_dir
from ..sources import runstore
from ..sources.catalog import table
from . import query

PLAN_SQL = ("null check", "duplicate check", "range check", "drift check", "orphan check", "total check", "sample")

RUNS = """runs AS (
  SELECT CAST(o_orderkey % 4 + 1 AS INTEGER) AS task_id, o_orderkey AS seed,
         CAST(o_custkey % 1001 - 20 AS DOUBLE) / 1000 AS score,
         o_orderkey % 7 AS start, o_orderkey % 6 + 1 AS steps
  FROM orders)"""


def _runs(spark, sf) -> DataFrame:
    plan = F.transform(
        F.sequence(F.lit(0), (F.col("o_orderkey") % 6).cast("int")),
        lambda i: F.element_at(
            F.array(*map(F.lit, PLAN_SQL)), ((F.col("o_orderkey") + i) % len(PLAN_SQL) + 1).cast("int")
        ),
    )
    return table(spark, sf, "orders").select(
        (F.col("o_orderkey") % 4 + 1).cast("int").alias("task_id"),
        F.col("o_orderkey").alias("seed"),
        ((F.col("o_custkey") % 1001 - 20).cast("double") / 1000).alias("score"),
        plan.alias("query_plan"),
    )


_TOP = f"""WITH {RUNS}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, seed) AS run_rank FROM runs)"""


@query(f"{_TOP} SELECT task_id, seed, score, CAST(run_rank AS INTEGER) AS run_rank FROM ranked WHERE run_rank <= 5")
def top_runs(spark, sf):
    return H.top_runs(_runs(spark, sf)).select("task_id", "seed", "score", "run_rank")


@query(f"{_TOP} SELECT task_id, seed, score FROM ranked WHERE run_rank <= 500")
def kept_runs(spark, sf):
    return H.keep_best_runs(_runs(spark, sf), 500).select("task_id", "seed", "score")


@query(f"WITH {RUNS} SELECT task_id, seed, score FROM runs ORDER BY task_id DESC, score DESC, seed LIMIT 500")
def kept_runs_overall(spark, sf):
    return H.keep_best_runs(_runs(spark, sf), 500, per_task=False).select("task_id", "seed", "score")


_NAMES = "[" + ",".join(f"'{n}'" for n in PLAN_SQL) + "]"


@query(f"""{_TOP}, used AS (
  SELECT task_id, score, place, ({_NAMES})[CAST((start + place) % 7 + 1 AS INTEGER)] AS query
  FROM ranked, (SELECT unnest(range(0, 6)) AS place) p WHERE run_rank <= 5 AND place < steps)
SELECT task_id, query, ROUND(SUM(greatest(0.0, 0.08 - 0.02 * place) * greatest(0.0, score)), 9) AS weight
FROM used GROUP BY 1, 2""")
def check_weights(spark, sf):
    return H.check_weights(_runs(spark, sf)).withColumn("weight", F.round("weight", 9))


@query(f"""{_TOP}, used AS (
  SELECT task_id, score, place, ({_NAMES})[CAST((start + place) % 7 + 1 AS INTEGER)] AS query
  FROM ranked, (SELECT unnest(range(0, 6)) AS place) p WHERE run_rank <= 5 AND place < steps),
weights AS (
  SELECT task_id, query, SUM(greatest(0.0, 0.08 - 0.02 * place) * greatest(0.0, score)) AS weight FROM used GROUP BY 1, 2),
asked AS (SELECT DISTINCT task_id, q AS query FROM runs, (SELECT unnest({_NAMES[:-1]}, 'never asked']) AS q) n)
SELECT task_id, query, ROUND(COALESCE(weight, 0.0), 9) AS weight FROM asked LEFT JOIN weights USING (task_id, query)""")
def check_weights_of_queries(spark, sf):
    """A weight for every query of a list, 0 for one that no top run used."""
    runs = _runs(spark, sf)
    asked = runs.select("task_id", F.explode(F.array(*map(F.lit, (*PLAN_SQL, "never asked")))).alias("query"))
    return H.check_weights(runs, queries=asked).withColumn("weight", F.round("weight", 9))


@query(f"{_TOP} SELECT task_id, seed, score, CAST(steps AS INTEGER) AS n_steps FROM ranked WHERE run_rank <= 300")
def stored_runs(spark, sf):
    """Runs added to a store in three parts, one of them twice; it keeps 300 of each task."""
    runs = _runs(spark, sf)
    folder = f"{ensure_checkpoint_dir(spark)}/runs-{uuid.uuid4()}"
    for part in (0, 1, 1, 2):
        runstore.add(runs.where(F.col("seed") % 3 == part), folder, keep=300)
    return runstore.read(spark, folder).select("task_id", "seed", "score", F.size("query_plan").alias("n_steps"))
