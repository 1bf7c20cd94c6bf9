"""Run queries in Spark and their SQL in DuckDB and compare the results row by row."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f'create view "{name}" as select * from read_parquet(\'{path}\')')
    return con


def _cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, float):
        return repr(value)
    return str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(spark_df, con, sql: str) -> list[str]:
    """What is different, empty when the results agree."""
    expected = con.execute(sql)
    names = [d[0] for d in expected.description]
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(set(names) ^ set(spark_df.columns))}"]
    want = _rows(names, expected.fetchall())
    got = _rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if len(want) != len(got):
        return [f"{len(got)} rows, expected {len(want)}"]
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if not bad:
        return []
    header = sorted(names)
    g, w = bad[0]
    where = [f"{h}: {a!r} != {b!r}" for h, a, b in zip(header, g, w) if a != b]
    return [f"{len(bad)} of {len(want)} rows, first {where[:4]} in {g[:3]}"]
