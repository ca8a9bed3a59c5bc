"""Comparison of a query with its SQL twin."""

from __future__ import annotations

import datetime as dt
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    return names, got.fetchall()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    if isinstance(v, dt.datetime):
        return v.date() if v.time() == dt.time() else v
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def same(df, sf_dir: str, sql: str) -> None:
    names, rows = duck(sf_dir, sql)
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, rows)
