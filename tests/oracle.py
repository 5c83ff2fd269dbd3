"""Side-by-side run of a registered query and its SQL twin."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def _normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(cells, key=lambda r: tuple((c is None, type(c).__name__, str(c)) for c in r))


def compare(spark, con, query, sql, sf_dir) -> str | None:
    """None when both agree, else what differs."""
    df = query(spark, sf_dir)
    ours = _normal(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    theirs = _normal([d[0] for d in cursor.description], cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"rows {len(ours[1])} != {len(theirs[1])}: {ours[1][:3]} / {theirs[1][:3]}"
    if ours[1] != theirs[1]:
        only_ours, only_theirs = set(ours[1]) - set(theirs[1]), set(theirs[1]) - set(ours[1])
        return f"{ours[0]}: only ours {sorted(only_ours, key=str)[:3]}, only theirs {sorted(only_theirs, key=str)[:3]}"
    for a, b in zip(ours[1], theirs[1]):
        if [type(x) for x in a] != [type(x) for x in b]:
            return f"types of {a} != {b}"
    return None
