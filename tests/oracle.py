"""Side-by-side comparison with DuckDB on the same Parquet tables."""

import decimal
import math
import os

import duckdb


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else repr(int(v)) if v == int(v) else repr(v)
    return None if v is None else str(v)


def rows_of(columns, rows):
    order = sorted(columns)
    key = lambda r: tuple((x is None, x or "") for x in r)
    return sorted((tuple(norm(dict(zip(columns, r, strict=True))[c]) for c in order) for r in rows), key=key)


def duck(sf_dir, sql):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    rel = con.execute(sql)
    columns = [c[0] for c in rel.description]
    return columns, rel.fetchall()


def same(df, sf_dir, sql):
    columns, rows = duck(sf_dir, sql)
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, rows)
