"""Compare a Spark result with the same query in DuckDB: columns by name, rows as a multiset."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{os.path.join(folder, name)}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else ("num", f"{value + 0.0:.4f}")
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, int):
        return ("int", value)
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(frame, con, sql: str) -> list[str]:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if sorted(names) != sorted(frame.columns):
        return [f"columns {sorted(set(names) ^ set(frame.columns))}"]
    out = [f"only in spark: {r}" for r in list((got - want))[:3]]
    return out + [f"only in oracle: {r}" for r in list((want - got))[:3]]
