"""Runs a query in Spark and its SQL in DuckDB and compares whole results."""

from __future__ import annotations

import glob
import os

import duckdb

TESTDATA = os.environ.get("SETSPAN_TESTDATA", "/root/testdata")


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]

    def cell(v):
        if v is None:
            return "NULL"
        if isinstance(v, float):
            return repr(v + 0.0)
        return str(v)

    return names, sorted(tuple(cell(r[i]) for i in order) for r in records)


def compare(spark, con, query, sql, sf_dir):
    """(rows, message); an empty message means equal."""
    df = query(spark, sf_dir)
    names, got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_names, want = rows([d[0] for d in cur.description], cur.fetchall())
    if names != want_names:
        return len(got), f"columns {names} != {want_names}"
    if len(got) != len(want):
        return len(got), f"{len(got)} rows != {len(want)}; e.g. {list(set(got) ^ set(want))[:4]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return len(got), f"{len(bad)} rows differ, e.g. {bad[:2]}" if bad else ""
