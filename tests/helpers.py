"""Comparison of queries with their SQL in DuckDB over one folder of Parquet tables."""

import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def norm(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, list):
        return tuple(norm(x) for x in v)
    return v


def sql_rows(sf_dir, sql):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    return names, cursor.fetchall()


def same(df, sf_dir, sql):
    names, rows = sql_rows(sf_dir, sql)
    columns = sorted(df.columns)
    assert sorted(names) == columns
    ours = sorted(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect())
    at = [names.index(c) for c in columns]
    theirs = sorted(repr(tuple(norm(r[i]) for i in at)) for r in rows)
    assert ours == theirs
