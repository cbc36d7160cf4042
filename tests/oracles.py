"""Spark's rows against DuckDB's."""

import os

import duckdb

DATA = os.environ.get("VERDIGRAPH_TESTDATA", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def database():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        path = f"{DATA}/{f}"
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def check(spark, con, query, sql):
    mine = query(spark, DATA).toArrow()
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(mine.column_names)
    theirs = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr)
    rows = zip(*[mine[c].to_pylist() for c in columns])
    assert sorted((tuple(map(plain, r)) for r in rows), key=repr) == theirs
