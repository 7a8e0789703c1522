"""Compares a query with its SQL: rows, columns and values, whatever their order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5)
    if isinstance(x, list):
        return tuple(map(plain, x))
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def compare(spark, query, sql, sf=None):
    sf = sf or SF
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    want = rows_of(names, found.fetchall())
    df = query(spark, sf)
    assert sorted(df.columns) == sorted(names), (sorted(df.columns), sorted(names))
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(want), (len(got), len(want), [x for x in got if x not in want][:3], [x for x in want if x not in got][:3])
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    assert not bad, (len(bad), bad[:3])
    return len(got)
