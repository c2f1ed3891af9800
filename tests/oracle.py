"""Run one registered query and its SQL side by side and compare the results."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if hasattr(value, "item"):
        return _plain(value.item())
    return value


def rows_of(columns: list[str], data) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_plain(row[i]) for i in order) for row in data]
    return [columns[i] for i in order], sorted(rows, key=repr)


def compare(spark, con, fn, sql: str, folder: str) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, folder)
    got_cols, got = rows_of(df.columns, df.collect())
    relation = con.sql(sql)
    want_cols, want = rows_of(relation.columns, relation.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    kinds = dict(zip(relation.columns, [str(t) for t in relation.types]))
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP"}
    for name, kind in df.dtypes:
        if names.get(kind, kind) != kinds[name]:
            return f"type of {name}: {kind} != {kinds[name]}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; spark only {list(set(got) - set(want))[:3]}, sql only {list(set(want) - set(got))[:3]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first {bad[:3]}"
    if not got:
        return "no rows"
    return None
