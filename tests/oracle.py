"""Compares a query's rows with those of its SQL on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if path.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def check(df, sql: str, sf_dir: str) -> int:
    """Asserts equal columns and rows; gives the number of rows."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = connect(sf_dir).execute(sql)
    want = rows_of([d[0] for d in res.description], res.fetchall())
    assert got[0] == want[0], (got[0], want[0])
    assert len(got[1]) == len(want[1]), (len(got[1]), len(want[1]))
    for g, w in zip(got[1], want[1], strict=True):
        same = all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-6) for x, y in zip(g, w, strict=True))
        assert same, (got[0], g, w)
    return len(got[1])
