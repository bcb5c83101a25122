"""Compares a registered query with its DuckDB SQL on one folder of tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def duck(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            con.sql(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' * os.path.isdir(p)}')")
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


def same(df, sql, sf_dir):
    names, rows = duck(sql, sf_dir)
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    order = sorted(names)
    want = sorted(tuple(_plain(r[names.index(c)]) for c in order) for r in rows)
    got = sorted(tuple(_plain(r[c]) for c in order) for r in df.collect())
    assert len(got) == len(want), (len(got), len(want))
    for g, w in zip(got, want):
        assert g == w
