"""Compares a query with its SQL as the driver does: columns by name, rows in any order."""

from __future__ import annotations

import glob
import math
import os


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def plain(v):
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else v.isoformat()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if hasattr(v, "as_tuple") or isinstance(v, int):
        return f"{float(v):.6g}" if hasattr(v, "as_tuple") else str(v)
    return [plain(x) for x in v] if isinstance(v, list | tuple) else str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(str([plain(r[i]) for i in order]) for r in values)


def same(spark, query, sql: str, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = duck(sf_dir).execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    odd = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    assert not odd, odd[:3]
