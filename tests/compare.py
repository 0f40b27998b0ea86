"""Comparison of a query's result with that of its SQL."""

from __future__ import annotations

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return repr(round(float(x), 9))
    if hasattr(x, "isoformat"):
        return str(x).removesuffix("+00:00")
    return str(x)


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(((*(cell(r[k]) for k in order),) for r in data), key=lambda r: tuple((x is None, x or "") for x in r))


def differences(df, sql: str, con) -> str:
    """What sets the two results apart, or an empty string."""
    got = df.collect()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, got), rows(names, cursor.fetchall())
    if a == b:
        return ""
    odd = [(x, y) for x, y in zip(a, b, strict=False) if x != y][:3]
    return f"{len(a)} and {len(b)} rows; {odd}"
