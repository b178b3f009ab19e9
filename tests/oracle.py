"""Runs a query and its SQL over the same Parquet tables and compares the rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if hasattr(x, "item"):
        return plain(x.item())
    return float(f"{x:.9g}") if type(x).__name__ == "Decimal" else x


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def sql_rows(sql: str, directory: str):
    con = duckdb.connect()
    for p in sorted(Path(directory).glob("*.parquet")):
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{at}')")
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    return columns, result.fetchall()


def differences(df, sql: str, directory: str) -> str:
    """Empty if equal."""
    columns, theirs = sql_rows(sql, directory)
    ours = [tuple(r) for r in df.collect()]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    a, b = rows_of(df.columns, ours), rows_of(columns, theirs)
    if a == b:
        return ""
    return f"{sum(a.values())} and {sum(b.values())} rows; only here {list((a - b).items())[:3]}; only there {list((b - a).items())[:3]}"
