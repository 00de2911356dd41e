"""A query's rows beside those of its SQL in DuckDB."""

import decimal
import math
import os

import duckdb


def cell(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if isinstance(v, float) and math.isnan(v) else repr(round(float(v), 6) + 0.0)
    return str(v)


def views(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def assert_same(df, con, sql):
    columns = sorted(df.columns)
    got = sorted(tuple(map(cell, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    cursor = con.execute(sql)
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = sorted(tuple(cell(r[i]) for i in places) for r in cursor.fetchall())
    assert len(got) == len(want)
    assert got == want
