"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seasontide.plans import (  # noqa: F401
    evaluation_queries,
    feature_queries,
    model_queries,
    source_queries,
    spatial_queries,
)
from seasontide.plans.registry import QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.run for name, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.sql for name, q in QUERIES.items() if q.sql}


def survey_ids() -> dict[str, str]:
    return {name: q.survey for name, q in QUERIES.items()}
