"""Rows of a Spark query and of its SQL in DuckDB, side by side."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    r = con.execute(sql)
    return [d[0] for d in r.description], r.fetchall()


def _cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return "nan" if math.isnan(f) else round(f, 6) + 0.0
    return str(v)


def same_rows(df, sf_dir: str, sql: str) -> str | None:
    """None if the rows are the same, else what differs."""
    names, rows = duck(sf_dir, sql)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = [df.columns.index(c) for c in names]
    mine = Counter(tuple(_cell(r[k]) for k in order) for r in df.collect())
    theirs = Counter(tuple(map(_cell, r)) for r in rows)
    if not theirs:
        return "no rows to compare"
    if mine != theirs:
        return f"{len(mine)} rows, {len(theirs)} expected; mine only {list((mine - theirs).items())[:3]}; expected only {list((theirs - mine).items())[:3]}; columns {names}"
    return None
