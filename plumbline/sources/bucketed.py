"""Tables that lie on disk by key, so that checks on that key move no row.

Two tables with equal buckets on their keys are joined and grouped bucket by bucket: the
checks of ``operators/relational.py`` then plan without an exchange of either. Worth it for
tables that are checked more often than they are written.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F


def bucket_sizes(df: DataFrame, keys: Iterable[str], n_buckets: int) -> DataFrame:
    """(bucket, n_rows) that ``write_bucketed`` would make. A key with a third of all rows
    makes a bucket with as many, which one task reads: leave such a table unbucketed, where
    rows are folded by key in every task before they move."""
    return df.groupBy(F.pmod(F.hash(*keys), F.lit(n_buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows"))


def write_bucketed(df: DataFrame, name: str, folder: str, keys: Iterable[str], n_buckets: int, files_per_bucket: int = 1) -> DataFrame:
    """Writes ``df`` to ``folder`` and registers it as the table ``name``.

    Rows go to their bucket by one exchange, the last that checks on ``keys`` need.
    ``files_per_bucket`` above 1 lets so many tasks write a large bucket. Joined tables need
    the same ``n_buckets`` and keys of one type. Raises when the table or folder is there already.
    """
    keys = list(keys)
    if files_per_bucket == 1:
        placed = df.repartition(n_buckets, *keys)
    else:
        plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
        spread = F.pmod(F.xxhash64(*plain), F.lit(files_per_bucket))  # the same in every retry
        placed = df.repartition(n_buckets * files_per_bucket, F.pmod(F.hash(*keys), F.lit(n_buckets)), spread)
    placed.write.mode("errorifexists").option("path", folder).bucketBy(n_buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(name)
    return df.sparkSession.table(name)
