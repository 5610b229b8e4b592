"""Spark results against DuckDB on the same tables."""

from __future__ import annotations

import datetime
import glob
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 4")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        files = path if os.path.isfile(path) else f"{path}/*.parquet"
        if glob.glob(files):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, int):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x if isinstance(x, str) else str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str | None:
    """What differs, or None."""
    ours = rows_of(df.columns, df.collect())
    done = con.execute(sql)
    theirs = rows_of([c[0] for c in done.description], done.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} and {len(theirs[1])} rows"
    return next((f"{a} and {b}" for a, b in zip(ours[1], theirs[1], strict=True) if a != b), None)
