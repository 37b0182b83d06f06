"""Runs a registered query and its SQL side by side."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v


def same(df, con, sql):
    """Equal columns and equal rows in any order."""
    result = con.execute(sql)
    names, rows = [c[0] for c in result.description], result.fetchall()
    columns = sorted(df.columns)
    assert columns == sorted(names)
    got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    want = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in rows), key=repr)
    assert got == want
