"""Compare a Spark query with its DuckDB oracle: same columns, same multiset of rows."""

import os
from collections import Counter

import duckdb

ROOT = "/root/testdata"


def _value(x):
    if x is None or x != x:
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return int(x) if x == int(x) else float(f"{x:.9g}")
    return str(x) if hasattr(x, "isoformat") else x


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], Counter(tuple(_value(r[k]) for k in order) for r in rows)


def connect(sf: str):
    con = duckdb.connect()
    for name in os.listdir(f"{ROOT}/{sf}"):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{ROOT}/{sf}/{name}'")
    return con


def check(df, con, sql: str) -> None:
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    want = _rows([d[0] for d in found.description], found.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1], (list((got[1] - want[1]).items())[:3], list((want[1] - got[1]).items())[:3])
