"""Compare a query's result with its SQL twin in DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.9g}" if value != 0 else "0"
    if isinstance(value, bool):
        return str(value)
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(df, con, sql) -> str | None:
    """None when equal, else a short description of the difference."""
    mine = normal(df.columns, [tuple(r) for r in df.collect()])
    compare.rows = len(mine[1])
    cursor = con.execute(sql)
    theirs = normal([d[0] for d in cursor.description], cursor.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if mine[1] != theirs[1]:
        left, right = set(mine[1]), set(theirs[1])
        return f"rows {len(mine[1])} vs {len(theirs[1])}; only spark {sorted(left - right)[:3]}; only sql {sorted(right - left)[:3]}"
    return None
