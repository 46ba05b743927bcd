"""Comparison of queries with their SQL in DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    return v


def _rows(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


def compare(df, con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    ours, theirs = _rows(df.columns, [tuple(r) for r in df.collect()]), _rows(names, got.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
