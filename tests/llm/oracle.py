"""Runs the registered SQL in DuckDB and compares rows without regard to order."""

import os

import duckdb
import pyarrow as pa

SF = "/root/testdata/sf0.01"


def connect(sf=SF, **tables):
    con = duckdb.connect()
    for file in os.listdir(sf):
        name = file.removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{sf}/{file}'")
    for name, table in tables.items():
        con.register("t_" + name, table if isinstance(table, pa.Table) else table.toArrow())
        con.execute(f"create or replace view {name} as select * from t_{name}")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: round(x, 9) if isinstance(x, float) else x
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr), [columns[i] for i in order]


def assert_same(df, sql, sf=SF, **tables):
    cur = connect(sf, **tables).execute(sql)
    want = rows([c[0] for c in cur.description], cur.fetchall())
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got[1] == want[1]
    assert len(got[0]) == len(want[0])
    assert got[0] == want[0]
    return len(got[0])
