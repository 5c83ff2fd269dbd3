"""Exact and near duplicates. No pair of rows is ever formed: both work on
group counts that combine inside each task before the shuffle, so a block of
copies holding a third of the table costs one row per task."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .spread import join_rows_with_keys


def distinct_records(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Each different record once, with its number of copies. NULLs are equal."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n_copies"))


def exact_duplicate_count(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows beyond the first of each group of identical records (0 if none)."""
    return distinct_records(df, columns).agg(
        F.coalesce(F.sum(F.col("n_copies") - 1), F.lit(0)).alias("duplicate_rows")
    )


def record_digest(df: DataFrame, columns: Iterable[str]) -> Column:
    """A 256-bit fingerprint of a record. JSON keeps field borders and NULLs
    apart, so different records give different texts; times keep microseconds
    and a negative zero equals zero, as in a plain ``groupBy``."""
    floats = (T.FloatType, T.DoubleType)
    fields = [
        (F.col(c) + F.lit(0.0)).alias(c) if isinstance(df.schema[c].dataType, floats) else F.col(c)
        for c in columns
    ]
    options = {
        "ignoreNullFields": "false",
        "timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
        "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
    }
    return F.sha2(F.to_json(F.struct(*fields), options), 256)


def exact_duplicate_count_wide(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """As ``exact_duplicate_count`` for wide records: the shuffle carries a
    32-byte fingerprint per record instead of all its columns."""
    digest = F.unhex(record_digest(df, columns)).alias("digest")
    return exact_duplicate_count(df.select(digest), ["digest"])


def duplicate_groups(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    return distinct_records(df, keys).where(F.col("n_copies") > 1)


# --- near duplicates ------------------------------------------------------
def _leave_out_sets(columns: list[str], anchors: list[str], n_changed: int) -> list[tuple[str, ...]]:
    free = [c for c in columns if c not in anchors]
    return list(combinations(free, n_changed))


def _check_anchors(columns: list[str], anchors: list[str], max_changed: int) -> None:
    if max_changed not in (1, 2):
        raise ValueError("max_changed must be 1 or 2")
    if max_changed == 2 and not anchors:
        raise ValueError("max_changed=2 needs anchor columns: without them unrelated rows match")
    if unknown := set(anchors) - set(columns):
        raise ValueError(f"anchors not among the compared columns: {sorted(unknown)}")
    if len(columns) - len(anchors) < max_changed:
        raise ValueError("not enough columns besides the anchors")


def _grouping_number(columns: list[str], left_out: tuple[str, ...]) -> int:
    """The grouping_id() of the grouping set made of every column not left out."""
    return sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c in left_out)


def _leave_out_groups(records: DataFrame, columns: list[str], sets: list[tuple[str, ...]],
                      *aggregates: Column) -> DataFrame:
    """Group distinct records by all columns but the left-out ones, for every
    leave-out set at once (GROUPING SETS: one expand, one shuffle)."""
    return records.groupingSets(
        [[F.col(c) for c in columns if c not in left_out] for left_out in sets], *columns
    ).agg(F.grouping_id().alias("set_id"), F.count(F.lit(1)).alias("n_variants"), *aggregates)


def _set_name(columns: list[str], sets: list[tuple[str, ...]]) -> Column:
    name = F.lit(None).cast("string")
    for left_out in sets:
        name = F.when(F.col("set_id") == _grouping_number(columns, left_out), ",".join(left_out)).otherwise(name)
    return name


def near_duplicate_groups(df: DataFrame, columns: Iterable[str], anchors: Iterable[str] = (),
                          max_changed: int = 1) -> DataFrame:
    """Groups of different records that agree on all but one or two columns.

    Anchors are never left out. A group over two columns is reported only if it
    holds a record that no single-column group matched; ``n_new`` counts those.
    The left-out columns are NULL in the output and named in ``left_out``.
    """
    columns, anchors = list(columns), list(anchors)
    _check_anchors(columns, anchors, max_changed)
    records = distinct_records(df, columns)
    ones = _leave_out_sets(columns, anchors, 1)
    copies = F.sum("n_copies").alias("n_rows")
    level1 = _leave_out_groups(records, columns, ones, copies).where(F.col("n_variants") > 1)

    def shown(groups: DataFrame, sets: list[tuple[str, ...]], n_new: Column) -> DataFrame:
        return groups.select(_set_name(columns, sets).alias("left_out"), *columns, "n_variants", n_new, "n_rows")

    every = F.col("n_variants").alias("n_new")
    if max_changed == 1:
        return shown(level1, ones, every)
    # used twice below: Spark runs its shuffle once and reads it for both
    twos = _leave_out_sets(columns, anchors, 2)
    marked = _mark_matched(records, level1, columns, ones)
    level2 = _leave_out_groups(
        marked, columns, twos, F.count_if(~F.col("matched")).alias("n_new"), copies
    ).where((F.col("n_variants") > 1) & (F.col("n_new") > 0))
    return shown(level1, ones, every).unionByName(shown(level2, twos, F.col("n_new")))


def _mark_matched(records: DataFrame, groups: DataFrame, columns: list[str],
                  sets: list[tuple[str, ...]]) -> DataFrame:
    """Add ``matched``: the record belongs to one of the groups."""
    types = {f.name: f.dataType for f in records.schema.fields}
    blocks = F.array(
        *(
            F.struct(
                F.lit(_grouping_number(columns, left_out)).cast("long").alias("set_id"),
                *(
                    (F.lit(None).cast(types[c]) if c in left_out else F.col(c)).alias(f"block_{c}")
                    for c in columns
                ),
            )
            for left_out in sets
        )
    )
    # records are distinct, so each joins at most one group per set
    exploded = records.select(*columns, "n_copies", F.inline(blocks))
    # a group meets as many rows as it has variants
    keys = groups.select(
        "set_id", *(F.col(c).alias(f"block_{c}") for c in columns),
        F.col("n_variants").alias("n_rows"), F.lit(1).alias("hit"),
    )
    hits = join_rows_with_keys(exploded, keys, ["set_id", *(f"block_{c}" for c in columns)], "left")
    return hits.groupBy(*columns).agg(
        F.max("n_copies").alias("n_copies"), (F.count("hit") > 0).alias("matched")
    )


def near_duplicate_count(df: DataFrame, columns: Iterable[str], anchors: Iterable[str] = (),
                         max_changed: int = 1) -> DataFrame:
    return near_duplicate_groups(df, columns, anchors, max_changed).agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.coalesce(F.sum("n_new"), F.lit(0)).alias("n_records"),
    )


def near_duplicate_count_wide(df: DataFrame, columns: Iterable[str], anchors: Iterable[str] = ()) -> DataFrame:
    """As ``near_duplicate_count`` for one change in wide records: the shuffles
    carry fingerprints of a record and of its leave-one-out blocks instead of
    the columns."""
    columns, anchors = list(columns), list(anchors)
    _check_anchors(columns, anchors, 1)
    blocks = F.array(*(
        F.struct(
            F.lit(i).alias("set_id"),
            F.unhex(record_digest(df, [c for c in columns if c not in left_out])).alias("block"),
        )
        for i, left_out in enumerate(_leave_out_sets(columns, anchors, 1))
    ))
    exploded = df.select(F.unhex(record_digest(df, columns)).alias("record"), F.inline(blocks))
    variants = exploded.distinct().groupBy("set_id", "block").agg(F.count(F.lit(1)).alias("n_variants"))
    return variants.where(F.col("n_variants") > 1).agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.coalesce(F.sum("n_variants"), F.lit(0)).alias("n_records"),
    )
