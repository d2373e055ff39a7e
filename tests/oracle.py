"""Compare a registered query with its SQL in DuckDB: columns by name, rows in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connection(sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return v if v is None or isinstance(v, (bool, str)) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def differences(spark_df, con, sql) -> str:
    result = con.execute(sql)
    want_names, want = rows([d[0] for d in result.description], result.fetchall())
    got_names, got = rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if got_names != want_names:
        return f"columns {got_names} and {want_names}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows: {got[:2]} {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(bad)} rows differ: {bad[:2]}" if bad else ""
