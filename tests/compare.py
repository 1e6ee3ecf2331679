"""Run one catalogued query in both engines and compare rows regardless of order."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def normal(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, 9) + 0.0)
    if isinstance(value, bool):
        return repr(value)
    if isinstance(value, int):
        return repr(value)
    if value is not None and type(value).__name__ == "Decimal":
        return f"decimal {value}"
    return repr(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in data)


def compare(spark, con, entry, sf_dir):
    """(status, detail, spark seconds, row count)"""
    start = time.time()
    df = entry.run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    if entry.sql is None:
        return "rows-only", "", spent, len(got)
    rel = con.execute(entry.sql)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    a, b = rows(df.columns, got), rows(names, want)
    if a[0] != b[0]:
        return "columns", f"{a[0]} vs {b[0]}", spent, len(got)
    if len(a[1]) != len(b[1]):
        return "count", f"{len(a[1])} vs {len(b[1])}", spent, len(got)
    if a[1] != b[1]:
        bad = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
        return "values", f"{len(bad)} differ, e.g. {bad[0]}", spent, len(got)
    return "ok", "", spent, len(got)
