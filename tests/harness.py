"""Runs a registered query next to its SQL oracle and compares the values."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os

import duckdb
import pandas as pd

DATA = "/root/testdata"


def spark_session(cores: int = 8, partitions: int = 8):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("seasontide")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def oracle_connection(sf: str):
    con = duckdb.connect()
    con.execute("SET threads = 4")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _value(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(_value(x) for x in v)
    if isinstance(v, dt.datetime) and v.time() == dt.time(0):
        return v.date()
    return v


def rows_of(records, columns, order):
    index = [columns.index(c) for c in order]
    return sorted((tuple(_value(r[i]) for i in index) for r in records), key=repr)


def compare(spark, con, run, sql, sf):
    """Empty string when equal, else a description of the first difference."""
    df = run(spark, sf)
    left = [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    types = {d[0]: str(d[1]) for d in result.description}
    columns = list(types)
    right = result.fetchall()
    order = sorted(df.columns)
    if order != sorted(columns):
        return f"columns {order} vs {sorted(columns)}"
    for name, kind in types.items():
        if kind in ("HUGEINT",) or kind.startswith("DECIMAL"):
            return f"oracle type {name} {kind}"
    a, b = rows_of(left, df.columns, order), rows_of(right, columns, order)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    if not a:
        return "no rows"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(bad)} of {len(a)} rows differ in {order}: {bad[:2]}"
    return ""
