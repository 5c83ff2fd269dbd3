"""Repairs: each returns a new frame and leaves its input as it was."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import vocabulary as V
from ..functions.columns import disguised_null, iso_date, parsed_number, text_date


def _expr(e) -> Column:
    return F.expr(e) if isinstance(e, str) else e


def update(df: DataFrame, assignments: Mapping[str, Column | str], where: Column | str) -> DataFrame:
    """``UPDATE … SET … WHERE …`` as a projection.

    All assignments read the old row. Rows for which the condition is false or
    NULL stay as they are; a new value takes the type of its column.
    """
    if unknown := set(assignments) - set(df.columns):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    condition = _expr(where)
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *(
            F.when(condition, _expr(assignments[c]).cast(types[c])).otherwise(F.col(c)).alias(c)
            if c in assignments
            else F.col(c)
            for c in df.columns
        )
    )


def _replace(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    return df.select(*(new[c].alias(c) if c in new else F.col(c) for c in df.columns))


def disguised_to_null(df: DataFrame, columns: Iterable[str], tokens: Iterable[str] = V.NULL_TOKENS) -> DataFrame:
    tokens = tuple(tokens)
    return _replace(df, {c: F.when(~disguised_null(c, tokens), F.col(c)) for c in columns})


def currency_to_decimal(df: DataFrame, column: str, decimal_type: str = "decimal(18,2)") -> DataFrame:
    """``$12.50`` -> 12.50; what is no finite number becomes NULL."""
    return _replace(df, {column: parsed_number(column).try_cast(decimal_type)})


def dates_to_iso(df: DataFrame, column: str, fmt: str = V.TEXT_DATE_PARSE_FORMAT) -> DataFrame:
    """Text dates in either form -> DATE; unreadable ones become NULL."""
    return _replace(df, {column: F.coalesce(iso_date(column), text_date(column, fmt))})


def drop_duplicates(df: DataFrame, keys: Iterable[str], order_by: Iterable[str] = (), keep: str = "first") -> DataFrame:
    """One row per key: the first (or last) by ``order_by``, ties broken by all
    other columns in table order, so the outcome never depends on task order.
    NULL sorts lowest. A map (or what holds one) has no order: it takes part in
    ties by its JSON text and can be no key and no ``order_by`` column.

    The choice is a minimum over whole rows, which combines inside each task
    before the shuffle. A window would bring all copies of a hot key to one task.
    """
    keys, order_by = list(keys), list(order_by)
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    ordered = [c for c in order_by if c not in keys] + rest
    if not ordered:
        return df.select(*df.columns).distinct()
    has_map = {f.name for f in df.schema.fields if "map<" in f.dataType.simpleString()}
    if unordered := has_map & {*keys, *order_by}:
        raise ValueError(f"maps have no order: {sorted(unordered)}")
    place = F.struct(*(c for c in ordered if c not in has_map), *(F.to_json(F.struct(c)).alias(f"__{c}") for c in ordered if c in has_map))
    if not has_map:
        pick = F.min if keep == "first" else F.max
        kept = df.groupBy(*keys).agg(pick(place).alias("kept"))
    else:
        pick_by = F.min_by if keep == "first" else F.max_by
        kept = df.groupBy(*keys).agg(pick_by(F.struct(*ordered), place).alias("kept"))
    return kept.select(*(F.col(c) if c in keys else F.col(f"kept.{c}").alias(c) for c in df.columns))


def quarantine(df: DataFrame, bad: Column) -> tuple[DataFrame, DataFrame]:
    """(clean, rejected). A NULL verdict is clean; no row is in both or neither."""
    flag = F.coalesce(bad, F.lit(False))
    return df.where(~flag), df.where(flag)


def judged(df: DataFrame, checks: Mapping[str, Column | str]) -> DataFrame:
    """Adds ``failed``: the names of the checks whose condition for a bad row holds, in the
    order of ``checks``; a NULL verdict is no failure. A column of that name is replaced."""
    failed = F.array_compact(F.array(*(F.when(_expr(bad), name) for name, bad in checks.items())))
    return df.select(*(c for c in df.columns if c.lower() != "failed"), failed.alias("failed"))


def split_by_verdict(df: DataFrame, checks: Mapping[str, Column | str], folder: str) -> tuple[DataFrame, DataFrame]:
    """(clean, rejected), written below ``folder`` as ``verdict=clean`` and ``verdict=rejected``.

    One scan judges and writes every row; either side is then read on its own, rejected
    rows with ``failed``, the checks they failed. Raises when ``folder`` is there already. A
    column named ``verdict`` or ``failed`` is replaced.
    """
    told = judged(df, checks).drop("verdict")
    told.withColumn("verdict", F.when(F.size("failed") > 0, "rejected").otherwise("clean")).write.mode("errorifexists").partitionBy("verdict").parquet(folder)
    whole = df.sparkSession.read.schema(T.StructType([*told.schema.fields, T.StructField("verdict", T.StringType())])).parquet(folder)
    clean, rejected = (whole.where(F.col("verdict") == v).drop("verdict") for v in ("clean", "rejected"))
    return clean.drop("failed"), rejected


def verified_update(df: DataFrame, assignments: Mapping[str, Column | str], where: Column | str, checks: Mapping[str, Column | str]) -> DataFrame:
    """(check, n_rows, n_bad_before, n_bad_after, n_fixed, n_still_bad, n_newly_broken) of an ``update``.

    Every check is evaluated on the old and on the new values of the same row, in one
    pass, so a repair that mends some rows and breaks as many others is seen.
    """
    checks = dict(checks)

    def verdicts(name: str) -> Column:
        return F.array(*(F.coalesce(_expr(bad), F.lit(False)) for bad in checks.values())).alias(name)

    own = [c for c in df.columns if not c.startswith("__")]
    before = df.select(*own, verdicts("__before"))
    after = update(before, assignments, where).select("__before", verdicts("__after"))
    each = F.arrays_zip(F.array(*map(F.lit, checks)).alias("check"), F.col("__before").alias("b"), F.col("__after").alias("a"))
    rows = after.select(F.inline(each).alias("check", "b", "a"))
    b, a = F.col("b"), F.col("a")
    counted = {"n_bad_before": b, "n_bad_after": a, "n_fixed": b & ~a, "n_still_bad": b & a, "n_newly_broken": ~b & a}
    return rows.groupBy("check").agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(c).alias(n) for n, c in counted.items()))


def compare_findings(before: DataFrame, after: DataFrame) -> DataFrame:
    """(check, table_name, column_name, n_bad_before, n_bad_after, n_fixed, is_resolved).

    Findings are one row per check, whatever the size of the audited table."""
    keys = ["check", "table_name", "column_name"]
    tagged = before.select(*keys, F.col("n_bad").alias("b"), F.lit(0).cast("long").alias("a")).unionByName(
        after.select(*keys, F.lit(0).cast("long").alias("b"), F.col("n_bad").alias("a"))
    )
    return tagged.groupBy(*keys).agg(
        F.sum("b").alias("n_bad_before"),
        F.sum("a").alias("n_bad_after"),
        (F.sum("b") - F.sum("a")).alias("n_fixed"),
        (F.sum("a") == 0).alias("is_resolved"),
    )
