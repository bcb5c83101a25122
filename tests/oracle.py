"""Compares a DataFrame with DuckDB SQL over the same folder of tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def same(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            con.sql(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' * os.path.isdir(p)}')")
    rel = con.sql(sql)
    assert sorted(rel.columns) == sorted(df.columns)
    order = sorted(rel.columns)
    want = sorted(tuple(plain(r[rel.columns.index(c)]) for c in order) for r in rel.fetchall())
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == w
