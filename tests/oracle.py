"""Compares a query's rows with DuckDB's on the same tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def expected(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def _plain(row: tuple) -> tuple:
    return tuple(round(float(x), 6) + 0.0 if isinstance(x, float) or type(x).__name__ == "Decimal" else x for x in row)


def differences(df, sql: str, sf_dir: str) -> list:
    names, rows = expected(sql, sf_dir)
    if sorted(names) != sorted(df.columns):
        return [("columns", sorted(names), sorted(df.columns))]
    order = sorted(names)
    own = sorted((_plain(tuple(r[n] for n in order)) for r in df.collect()), key=repr)
    other = sorted((_plain(tuple(r[names.index(n)] for n in order)) for r in rows), key=repr)
    if len(own) != len(other):
        return [("rows", len(own), len(other))]
    same = lambda a, b: a == b or isinstance(a, float) and isinstance(b, (int, float)) and math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return [(a, b) for a, b in zip(own, other, strict=True) if not all(map(same, a, b))][:5]
