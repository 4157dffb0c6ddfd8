"""Spark results against DuckDB's on the same tables."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return int(x) if isinstance(x, bool) is False and hasattr(x, "is_integer") and not isinstance(x, int) and float(x).is_integer() else x


def differences(spark, queries, oracles, name: str, sf_dir: str, con=None) -> str:
    """What sets the two results apart; nothing if they agree."""
    got = queries[name](spark, sf_dir)
    cols = sorted(got.columns)
    rows = Counter(tuple(plain(v) for v in r) for r in got.select(*(f"`{c}`" for c in cols)).collect())
    cur = (con or duck(sf_dir)).execute(oracles[name])
    names = [c[0] for c in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} and {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())
    if rows == want:
        return ""
    return f"{sum(rows.values())} rows and {sum(want.values())}; only here {list((rows - want).items())[:3]}; only there {list((want - rows).items())[:3]}"
