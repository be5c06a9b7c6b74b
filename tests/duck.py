"""Compare a query with its SQL on the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 8) + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 8) + 0.0) if v % 1 else repr(int(v))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return repr(v)


def compare(df, con, sql):
    cols = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in at) for r in res.fetchall())
    assert len(got) == len(want)
    assert got == want
