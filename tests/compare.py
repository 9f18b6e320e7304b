"""Runs a query in Spark and its SQL in DuckDB and compares columns, kinds and rows."""

from __future__ import annotations

import decimal
import glob
import os

import duckdb


def kind(t: str) -> str:
    t = t.lower()
    if "[]" in t or t.startswith("array") or t.startswith("struct"):
        return "nested"
    if t in ("bigint", "int", "integer", "smallint", "tinyint", "hugeint", "long", "short", "byte"):
        return "int" if t != "hugeint" else "hugeint"
    if t in ("double", "float", "real"):
        return "double"
    return {"varchar": "string", "string": "string", "boolean": "boolean"}.get(t, t)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, decimal.Decimal):
        return float(x)
    return x


def differences(spark, sf_dir: str, name: str, run, sql: str) -> str:
    df = run(spark, sf_dir)
    rel = duck(sf_dir).sql(sql)
    a = {f.name: kind(f.dataType.simpleString()) for f in df.schema}
    b = {n: kind(str(t)) for n, t in zip(rel.columns, rel.types, strict=True)}
    if a != b:
        return f"{name}: columns {a} and {b}"
    cols = sorted(a)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    x = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    at = [rel.columns.index(c) for c in cols]
    y = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=key)
    if x == y:
        return ""
    sx, sy = set(map(str, x)), set(map(str, y))
    return f"{name}: {len(x)} and {len(y)} rows; {cols}; only in Spark {sorted(sx - sy)[:3]}; only in SQL {sorted(sy - sx)[:3]}"
