"""Deterministic keep-first and row numbering without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasontide.functions.checkpoints import reliable


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key, the first in ``order``.

    Written as ``row_number() = 1`` so that Spark plans a partial group limit
    ahead of the shuffle: each map task sends at most one row per key, however
    many copies a hot key has.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """At most ``n`` rows per key, with the same partial group limit."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def number_rows(df: DataFrame, order: Sequence[Column | str], name: str = "row_number") -> DataFrame:
    """Consecutive numbers 1..n in a total order.

    A range-partitioned sort numbers rows inside each partition; the partition
    sizes (one row per partition) give the offsets.  The sorted rows are
    checkpointed, as both steps must see the same partition bounds.
    """
    placed = reliable(
        df.orderBy(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_start"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        placed.join(offsets, "_part")
        .withColumn(name, F.col("_offset") + F.col("_seq") - F.col("_start") + 1)
        .drop("_part", "_seq", "_start", "_offset")
    )


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys that may be NULL, keeping the left copy of the keys."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])
