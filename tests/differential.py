"""Run a query on Spark and its counterpart on DuckDB and compare rows without regard to order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return bytes(v) if isinstance(v, bytearray) else v


def assert_same(df, con, sql):
    found = con.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(found.columns)
    at = [found.columns.index(c) for c in columns]
    ours = sorted((tuple(_norm(r[c]) for c in columns) for r in df.collect()), key=str)
    theirs = sorted((tuple(_norm(r[k]) for k in at) for r in found.fetchall()), key=str)
    assert [str(x) for x in ours] == [str(x) for x in theirs]
