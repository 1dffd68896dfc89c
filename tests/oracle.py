"""Compares a query with its SQL on the small tables."""

import os

import duckdb

SMALL = "/root/testdata/sf0.001"


def rounded(x):
    if isinstance(x, float):
        return "nan" if x != x else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return str([rounded(y) for y in x])
    return x


def rows(cells, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(rounded(r[i]) for i in order) for r in cells), key=lambda r: tuple(map(str, r)))


def connect(folder=SMALL):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    return c


def same(spark, query, sql, folder=SMALL):
    df = query(spark, folder)
    got = rows([tuple(r) for r in df.collect()], df.columns)
    rel = connect(folder).sql(sql)
    want = rows(rel.fetchall(), list(rel.columns))
    assert got[0] == want[0]
    assert got[1] == want[1]
