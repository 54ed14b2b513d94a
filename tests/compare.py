"""Run a query and its SQL equivalent on the same tables and compare the results."""

from __future__ import annotations

import glob
import hashlib
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def rows_of_frame(df) -> tuple[list[str], list[tuple]]:
    columns = sorted(df.columns)
    return columns, sorted(map(repr, map(tuple, df.select(*columns).collect())))


def rows_of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    columns = sorted(names)
    order = [names.index(c) for c in columns]
    rows = [tuple(r[i] for i in order) for r in result.fetchall()]
    return columns, sorted(map(repr, rows))


def digest(rows: list[str]) -> str:
    return hashlib.sha256("\n".join(rows).encode()).hexdigest()


def difference(df, con, sql: str) -> str | None:
    """None if equal, else what differs first."""
    got_columns, got = rows_of_frame(df)
    want_columns, want = rows_of_sql(con, sql)
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        extra = sorted(set(got) - set(want))[:2]
        missing = sorted(set(want) - set(got))[:2]
        return f"{len(got)} rows != {len(want)}; only here {extra}; only there {missing}"
    if digest(got) != digest(want):
        pairs = [(g, w) for g, w in zip(got, want) if g != w]
        return f"{len(pairs)} rows differ, first {pairs[0][0][:300]} != {pairs[0][1][:300]}"
    return None
