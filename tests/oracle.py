"""Compares a query with its SQL run by DuckDB on the same tables, as sets of rows with equal columns."""

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, (int, float)):
        return round(float(v), 6)
    if hasattr(v, "timestamp"):
        return str(v)[:19]
    return v


def sql_rows(sql: str, sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def compare(df, sql: str, sf: str) -> str:
    """The difference in words, empty if there is none."""
    names, want = sql_rows(sql, sf)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = [names.index(c) for c in df.columns]
    got = Counter(tuple(value(v) for v in r) for r in df.collect())
    said = Counter(tuple(value(r[i]) for i in order) for r in want)
    if got == said:
        return ""
    a, b = got - said, said - got
    return f"{sum(got.values())} and {sum(said.values())} rows; only here {list(a.items())[:3]}, only in SQL {list(b.items())[:3]}"
