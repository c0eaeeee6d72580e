"""Runs a registered query and its SQL on the same tables and compares the values."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

from loomline.tables import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    values = [tuple(_plain(r[i]) for i in order) for r in rows]
    return names, sorted(values, key=repr)


def spark_rows(df):
    return normal(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    cursor = con.execute(sql)
    return normal([c[0] for c in cursor.description], cursor.fetchall())


def kinds(rows, width):
    out = []
    for i in range(width):
        seen = {type(r[i]).__name__ for r in rows if r[i] is not None}
        out.append(",".join(sorted(seen)))
    return out


def difference(got, want) -> str | None:
    """None when equal, else what differs first."""
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    a, b = kinds(got[1], len(got[0])), kinds(want[1], len(want[0]))
    if a != b:
        return f"types {list(zip(got[0], a, b))}"
    for x, y in zip(got[1], want[1]):
        if x != y:
            return f"row {x} != {y}"
    return None
