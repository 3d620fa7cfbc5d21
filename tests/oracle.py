"""Comparison of a query with its SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def _plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v


def rows_of(df) -> tuple[list[str], list[str]]:
    columns = sorted(df.columns)
    return columns, sorted(repr(tuple(_plain(r[c]) for c in columns)) for r in df.collect())


def sql_rows(folder: str, sql: str) -> tuple[list[str], list[str]]:
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    columns = sorted(names)
    return columns, sorted(repr(tuple(_plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())
