"""Joins of rows with a set of keys that stay even when a key is hot.

Adaptive execution splits a hot partition only when both join sides come
straight from a shuffle, and only along the tasks that wrote it. A key set that
was just aggregated does not, and rows that were already shuffled on the key
come from one task. But such a set knows how many rows each key will meet: a key
with more than ``rows_per_task`` is dealt over as many salts as it has that many
rows, so the salts grow with the key. The salt is a hash of the whole row (and
of the task that made it, which tells equal rows apart), the same in every
retry. Only hot keys are repeated, once per salt. No row is dropped.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

#: Rows of one key that a task should meet at most. The hot keys that are
#: broadcast are at most one per so many rows of the table, with 12 bytes each:
#: 12 MB for a table of 10^12 rows.
ROWS_PER_TASK = 1_000_000
_SALT = "__salt"


def _same(left: DataFrame, right: DataFrame, on: list[str]) -> Column:
    condition = F.lit(True)
    for c in on:
        condition = condition & left[c].eqNullSafe(right[f"__key_{c}"])
    return condition


def join_rows_with_keys(rows: DataFrame, keys: DataFrame, on: Iterable[str], how: str = "left_semi",
                        n_rows: str = "n_rows", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Join ``rows`` with ``keys`` on equal or both-NULL columns.

    ``keys`` has one row per key and in column ``n_rows`` the number of rows
    the key has in ``rows``. ``how`` is ``inner``, ``left``, ``left_semi`` or
    ``left_anti``; the first two keep the further columns of ``keys``.
    """
    on = list(on)
    types = {f.name: f.dataType for f in rows.schema.fields}
    further = [c for c in keys.columns if c not in (*on, n_rows)]
    sized = keys.select(
        *(F.col(c).cast(types[c]).alias(f"__key_{c}") for c in on), *further,
        F.ceil(F.col(n_rows) / F.lit(rows_per_task)).cast("int").alias("__salts"),
    )
    # two keys of one hash are both dealt over the larger number of salts, on either side
    hash_of_key = F.xxhash64(*(f"__key_{c}" for c in on)).alias("__hash")
    hot = sized.where(F.col("__salts") > 1).groupBy(hash_of_key).agg(F.max("__salts").alias("__n_salts"))

    hashed = rows.withColumn("__hash", F.xxhash64(*on)).join(F.broadcast(hot), "__hash", "left")
    hashable = [f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]
    salt = F.pmod(F.xxhash64(*hashable, F.spark_partition_id()), F.coalesce("__n_salts", F.lit(1))).cast("int")
    salted = hashed.select(*rows.columns, salt.alias(_SALT))
    judged = sized.withColumn("__hash", hash_of_key).join(F.broadcast(hot), "__hash", "left")
    repeated = judged.select(
        *(f"__key_{c}" for c in on), *further,
        F.explode(F.sequence(F.lit(0), F.coalesce("__n_salts", F.lit(1)) - 1)).alias(f"__key{_SALT}"),
    )
    joined = salted.join(
        repeated, _same(salted, repeated, on) & (salted[_SALT] == repeated[f"__key{_SALT}"]), how
    )
    return joined.select(*rows.columns, *(further if how in ("inner", "left") else []))
