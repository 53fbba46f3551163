"""Runs a registered query in Spark and its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import math

import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute("SET max_temp_directory_size = '2GB'")
    con.execute("SET memory_limit = '8GB'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


SECONDS = {"spark": 0.0, "duck": 0.0}


def _cell(v):
    if isinstance(v, bool):
        return ("bool", v)
    if isinstance(v, int):
        return ("int", v)
    if isinstance(v, float):
        return ("nan", 0) if math.isnan(v) else ("float", float(repr(v)) + 0.0)
    if v is None:
        return ("null", "")
    return (type(v).__name__, str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences as text; an empty list means equal."""
    start = time.time()
    got_columns = spark_df.columns
    got = rows_of(got_columns, [tuple(r) for r in spark_df.collect()])
    middle = time.time()
    cur = con.execute(sql)
    want_columns = [d[0] for d in cur.description]
    want = rows_of(want_columns, cur.fetchall())
    SECONDS.update(spark=middle - start, duck=time.time() - middle)
    problems = []
    if sorted(got_columns) != sorted(want_columns):
        problems.append(f"columns {sorted(got_columns)} != {sorted(want_columns)}")
    if len(got) != len(want):
        problems.append(f"rows {len(got)} != {len(want)}")
    diff = [(g, w) for g, w in zip(got, want) if g != w]
    if diff:
        problems.append(f"{len(diff)} rows differ, first: {sorted(got_columns)}\n   spark {diff[0][0]}\n   duck  {diff[0][1]}")
    if not got:
        problems.append("no rows at all")
    return problems
