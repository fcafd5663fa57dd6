"""Holds a query against its SQL: the same columns, and the same rows in any order."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    con.execute("SET TimeZone = 'UTC'")
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    return names, done.fetchall()


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return float(v)
    return v


def _sorted(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    key = lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=key)


def differences(df, sql: str, sf_dir: str) -> list:
    """The first pairs of rows that differ."""
    names, theirs = sql_rows(sql, sf_dir)
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    ours = _sorted(df.columns, [tuple(r) for r in df.collect()])
    theirs = _sorted(names, theirs)
    assert len(ours) == len(theirs), (len(ours), len(theirs))
    return [(a, b) for a, b in zip(ours, theirs) if a != b][:3]
