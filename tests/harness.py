"""Runs a registered query in Spark and its SQL twin in DuckDB and compares names, types and values."""

from __future__ import annotations

import datetime
import decimal
import math
import os

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, float):
        if math.isnan(v):
            return ("f", "nan")
        return ("f", repr(v + 0.0 if v != 0 else 0.0))
    if isinstance(v, int):
        return ("i", str(v))
    if isinstance(v, decimal.Decimal):
        return ("d", str(v))
    if isinstance(v, datetime.datetime):
        return ("t", v.replace(tzinfo=None).isoformat())
    return ("s", str(v)) if v is not None else ("n", "")


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """None if equal, else a description of the first difference."""
    spark_rows = [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    duck_columns = [d[0] for d in result.description]
    duck_rows = result.fetchall()
    a_cols, a = _canonical(df.columns, spark_rows)
    b_cols, b = _canonical(duck_columns, duck_rows)
    if a_cols != b_cols:
        return f"columns {a_cols} != {b_cols}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; spark {a[:2]} duckdb {b[:2]}"
    for x, y in zip(a, b):
        if x != y:
            return f"{a_cols}: spark {x} != duckdb {y}"
    return None
