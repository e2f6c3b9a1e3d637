"""Compares registered queries with their SQL on DuckDB: columns by name, rows as a bag."""

from __future__ import annotations

import datetime
import math
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if hasattr(v, "asDict"):
        return tuple(sorted((k, plain(x)) for k, x in v.asDict().items()))
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows(columns, values) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in values)


def differences(spark, sf_dir: str, query, sql: str) -> list[str]:
    """What differs, in words; empty if nothing does."""
    df = query(spark, sf_dir)
    mine = rows(df.columns, df.collect())
    got = connect(sf_dir).execute(sql)
    columns = [d[0] for d in got.description]
    theirs = rows(columns, got.fetchall())
    out = []
    if sorted(columns) != sorted(df.columns):
        out.append(f"columns {sorted(df.columns)} and {sorted(columns)}")
    if mine != theirs:
        out.append(f"{sum(mine.values())} and {sum(theirs.values())} rows; only in Spark {list((mine - theirs).items())[:3]}, only in SQL {list((theirs - mine).items())[:3]}")
    return out
