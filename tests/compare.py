"""Order-independent comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "∅"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, (int, float)):
        return repr(float(x))
    if isinstance(x, datetime.datetime):
        return x.isoformat(sep=" ")
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str) -> list[str]:
    have_columns, have = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if have_columns != want_columns:
        return [f"columns {have_columns} != {want_columns}"]
    out = []
    if len(have) != len(want):
        out.append(f"rows {len(have)} != {len(want)}")
    if have != want:
        only_have, only_want = set(have) - set(want), set(want) - set(have)
        out.append(f"{len(only_have)} only in Spark, {len(only_want)} only in SQL")
        out += [f"  spark {sorted(only_have)[:2]}", f"  sql   {sorted(only_want)[:2]}"]
    return out
