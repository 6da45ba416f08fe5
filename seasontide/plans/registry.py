"""Registered queries: a Spark function, its survey id, and its SQL oracle where one exists."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasontide.functions.checkpoints import ensure_checkpoint_dir
from seasontide.plans.oracle_views import VIEWS


@dataclass(frozen=True)
class Query:
    name: str
    survey: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def with_views(sql: str) -> str:
    """Prefix the view definitions that the SQL mentions, directly or through other views."""
    if sql.lstrip().upper().startswith("WITH"):
        sql = f"SELECT * FROM ({sql})"
    needed: set[str] = set()
    pending = [sql]
    while pending:
        text = pending.pop()
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                pending.append(body)
    if not needed:
        return sql
    parts = [f"{name} AS ({body})" for name, body in VIEWS.items() if name in needed]
    return "WITH " + ",\n".join(parts) + "\n" + sql


def query(name: str, survey: str, sql: str | None = None, rounds: str = "", digits: int = 6):
    """Register a query.  ``rounds`` names the float columns rounded on both sides."""
    columns = rounds.split()

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf: str) -> DataFrame:
            df = fn(spark, sf)
            # adding zero turns a rounded -0.0 into 0.0
            return df.withColumns({c: F.round(c, digits) + 0.0 for c in columns})

        text = sql
        if sql and columns:
            replaced = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)
            text = f"SELECT * REPLACE ({replaced}) FROM ({sql})"
        QUERIES[name] = Query(name, survey, run, with_views(text) if text else None)
        return fn

    return register


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder, for queries that write."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"
