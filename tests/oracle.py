"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import math
import os

import duckdb


def connect(sf: str):
    con = duckdb.connect()
    for f in os.listdir(sf):
        p = f"{sf}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def rows(pdf):
    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>"):
            return None
        if isinstance(v, float) or type(v).__name__.startswith("float"):
            return round(float(v), 6)
        if hasattr(v, "__len__") and not isinstance(v, str):
            return repr(list(v))
        return v.item() if hasattr(v, "item") else v

    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple(cell(v) for v in r) for r in pdf.itertuples(index=False, name=None)), key=repr)


def compare(spark, con, sf, query, sql):
    a, b = query(spark, sf).toPandas(), con.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    x, y = rows(a), rows(b)
    assert len(x) == len(y), (len(x), len(y))
    for r, s in zip(x, y):
        for v, w in zip(r, s):
            same = v == w or isinstance(v, (int, float)) and isinstance(w, (int, float)) and math.isclose(v, w, rel_tol=1e-6, abs_tol=2e-6)
            assert same, (r, s)
