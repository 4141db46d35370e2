"""Runs registered queries in Spark and their SQL in DuckDB over the same tables and compares."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str = SF_DIR):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def spark_rows(df):
    names = sorted(df.columns)
    rows = df.select(*[f"`{n}`" for n in names]).collect()
    return names, sorted((tuple(plain(x) for x in r) for r in rows), key=repr)


def duck_rows(con, sql):
    relation = con.sql(sql)
    names = list(relation.columns)
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(plain(r[i]) for i in order) for r in relation.fetchall()]
    return [names[i] for i in order], sorted(rows, key=repr)


def differences(df, con, sql) -> str | None:
    """Description of the first difference, None when results are equal."""
    got_names, got = spark_rows(df)
    want_names, want = duck_rows(con, sql)
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; first {got[:2]} / {want[:2]}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} != {b}"
    return None
