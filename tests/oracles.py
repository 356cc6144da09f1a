"""Queries against their SQL in DuckDB, row by row."""

import os
from pathlib import Path

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def database(d=SF):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(Path(d).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if v == v else "nan"
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same(spark, query, sql, d=SF):
    """Asserts that both give the same columns and the same bag of rows; returns their number."""
    df = query(spark, d)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = database(d).execute(sql)
    want = table([c[0] for c in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    for a, b in zip(got[1], want[1], strict=True):
        assert a == b
    return len(got[1])
