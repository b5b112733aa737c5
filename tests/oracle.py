"""Runs the registered SQL in DuckDB and compares rows without regard to order."""

import os

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf=SF):
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{sf}/{file}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr), [columns[i] for i in order]


def same(df, con, sql):
    cur = con.execute(sql)
    want = rows([c[0] for c in cur.description], cur.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    return got == want, got, want
