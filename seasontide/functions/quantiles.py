"""Exact percentiles of groups of any size.

``percentile`` keeps every distinct value of a group in one task's buffer.  That
is right for whole-day errors (a few hundred values) but not for fractional
measures of a group that may hold a third of all rows.  Here the values are
counted first (shuffled by value, so a hot group spreads over the cluster), then
narrowed to the bins that hold the wanted ranks, and only those bins are sorted.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasontide.functions.checkpoints import reliable
from seasontide.functions.ordering import join_on

BINS_PER_UNIT = 1024
REACH = 2048.0


def _bin(value: str):
    return F.floor(F.greatest(F.least(F.col(value), F.lit(REACH)), F.lit(-REACH)) * BINS_PER_UNIT)


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str, float]]
) -> DataFrame:
    """``keys`` plus one column per entry ``name -> (value column, p)``.

    Linear interpolation between the two nearest ranks; NULL and NaN are
    ignored; groups without a value are absent.  Bins are 1/1024 wide inside
    +-2048 (days), so the per-group bin table has a fixed size bound.
    """
    return _solve(_value_counts(df, list(keys), _columns(wanted)), list(keys), wanted)


def level_percentiles(
    df: DataFrame, levels: Sequence[Sequence[str]], wanted: Mapping[str, tuple[str, float]]
) -> list[DataFrame]:
    """``exact_percentiles`` at several levels of grouping, from one count of the values.

    The first level holds the keys of all others.
    """
    keys = list(levels[0])
    counts = reliable(_value_counts(df, keys, _columns(wanted)))
    out = []
    for level in levels:
        coarse = counts if list(level) == keys else counts.groupBy(*level, "_m", "_v", "_b").agg(F.sum("_n").alias("_n"))
        out.append(_solve(coarse, list(level), wanted))
    return out


def complement_percentiles(
    df: DataFrame, key: str, groups: Sequence[int], wanted: Mapping[str, tuple[str, float]]
) -> DataFrame:
    """For each of a handful of ``groups``: ``exact_percentiles`` of the rows of all others.

    Rows are counted by value once; only the counts are multiplied by the groups.
    Rows without a ``key`` are left out.
    """
    columns = _columns(wanted)
    named = F.array(*[F.lit(int(g)) for g in groups]).cast("array<int>")
    counts = reliable(_value_counts(df.where(F.col(key).isNotNull()), [key], columns))
    others = F.filter(named, lambda g: g != F.col(key))
    spread = counts.withColumn("_g", F.explode(others)).groupBy("_g", "_m", "_v", "_b").agg(F.sum("_n").alias("_n"))
    return _solve(spread, ["_g"], wanted).withColumnRenamed("_g", key)


def _columns(wanted: Mapping[str, tuple[str, float]]) -> list[str]:
    return list(dict.fromkeys(column for column, _ in wanted.values()))


def _value_counts(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, _m, _v, _b, _n): the values of each column with their bin and number; NULL and NaN are left out."""
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("m"), F.col(c).cast("double").alias("v"))
            for i, c in enumerate(columns)
        ]
    )
    values = (
        df.select(*keys, F.explode(pairs).alias("_e"))
        .select(*keys, F.col("_e.m").alias("_m"), F.col("_e.v").alias("_v"))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    )
    return values.groupBy(*keys, "_m", "_v").agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", _bin("_v"))


def _solve(counts: DataFrame, keys: list[str], wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    columns = _columns(wanted)
    probs = [sorted({p for column, p in wanted.values() if column == c}) for c in columns]
    group = Window.partitionBy(*keys, "_m")
    before = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    prob_table = F.array(*[F.array(*[F.lit(float(p)) for p in ps]) for ps in probs])
    bins = (
        counts.groupBy(*keys, "_m", "_b")
        .agg(F.sum("_n").alias("_bn"))
        .withColumn("_before", F.coalesce(F.sum("_bn").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_bn").over(group))
        .withColumn(
            "_ranks",
            F.transform(
                F.element_at(prob_table, F.col("_m") + 1),
                lambda p: F.struct(
                    p.alias("p"),
                    F.floor(p * (F.col("_total") - 1)).alias("lo"),
                    F.ceil(p * (F.col("_total") - 1)).alias("hi"),
                    (p * (F.col("_total") - 1)).alias("pos"),
                ),
            ),
        )
        .withColumn(
            "_ranks",
            F.filter(
                "_ranks",
                lambda r: (r["hi"] >= F.col("_before"))
                & (r["lo"] < F.col("_before") + F.col("_bn")),
            ),
        )
        .where(F.size("_ranks") > 0)
    )
    left = counts.alias("c")
    right = bins.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_m").alias("_bm"),
        F.col("_b").alias("_bb"),
        "_before",
        "_ranks",
    )
    condition = (F.col("_m") == F.col("_bm")) & (F.col("_b") == F.col("_bb"))
    for i, k in enumerate(keys):
        condition = condition & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    running = Window.partitionBy(*keys, "_m", "_b").orderBy("_v")
    picked = (
        left.join(right, condition)
        .withColumn(
            "_end",
            F.col("_before")
            + F.sum("_n").over(running.rowsBetween(Window.unboundedPreceding, 0)),
        )
        .select(*keys, "_m", "_v", "_n", "_end", F.explode("_ranks").alias("_r"))
    )

    def holds(rank: str):
        target = F.col(f"_r.{rank}")
        return (target < F.col("_end")) & (target >= F.col("_end") - F.col("_n"))

    solved = (
        picked.groupBy(*keys, "_m", F.col("_r.p").alias("_p"))
        .agg(
            F.max(F.when(holds("lo"), F.col("_v"))).alias("_lo"),
            F.max(F.when(holds("hi"), F.col("_v"))).alias("_hi"),
            F.first(F.col("_r.pos") - F.col("_r.lo")).alias("_frac"),
        )
        .withColumn("_q", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac"))
    )
    picks = [
        F.max(
            F.when((F.col("_m") == columns.index(c)) & (F.col("_p") == float(p)), F.col("_q"))
        ).alias(name)
        for name, (c, p) in wanted.items()
    ]
    return solved.groupBy(*keys).agg(*picks) if keys else solved.agg(*picks)


def with_percentiles(
    summary: DataFrame,
    detail: DataFrame,
    keys: Sequence[str],
    wanted: Mapping[str, tuple[str, float]],
) -> DataFrame:
    """Attach exact percentiles of ``detail`` to a per-key summary of it."""
    return join_on(summary, exact_percentiles(detail, keys, wanted), keys)




def prefix_medians(
    df: DataFrame,
    group: str,
    columns: Sequence[str],
    cutoffs: Sequence[int],
    window: int | None = None,
) -> DataFrame:
    """(cutoff, column, median): exact medians of the rows whose ``group`` is below each cutoff.

    With ``window``, ``group`` lies at most that far below.

    ``column`` is the place in ``columns``; columns without a value are absent.  Rows
    are counted by value once, whatever the number of cutoffs; only the counts of bins
    and of the values in the middle bins are multiplied.
    """
    sees = lambda c, g: (g < c) & (F.lit(True) if window is None else g >= c - window)
    later = lambda g: F.filter(
        F.array(*[F.lit(int(c)) for c in cutoffs]).cast("array<int>"), lambda c: sees(c, F.col(g))
    )
    pairs = F.array(
        *[F.struct(F.lit(i).alias("m"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)]
    ).cast("array<struct<m: int, v: double>>")
    counts = reliable(
        df.select(F.col(group).alias("_g"), F.explode(pairs).alias("_e"))
        .select("_g", F.col("_e.m").alias("_m"), F.col("_e.v").alias("_v"))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy("_g", "_m", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_b", _bin("_v"))
    )
    series = Window.partitionBy("_c", "_m")
    middle = (
        counts.groupBy("_g", "_m", "_b")
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_c", F.explode(later("_g")))
        .groupBy("_c", "_m", "_b")
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_end", F.sum("_n").over(series.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_total", F.sum("_n").over(series))
        .withColumn("_lo", F.floor((F.col("_total") - 1) / 2))
        .withColumn("_hi", F.ceil((F.col("_total") - 1) / 2))
        .where("_hi >= _end - _n and _lo < _end")
        .select("_c", "_m", "_b", (F.col("_end") - F.col("_n")).alias("_before"), "_lo", "_hi")
    )
    inner = Window.partitionBy("_c", "_m", "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    values = (
        counts.join(middle, ["_m", "_b"])
        .where(sees(F.col("_c"), F.col("_g")))
        .groupBy("_c", "_m", "_b", "_before", "_lo", "_hi", "_v")
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_end", F.col("_before") + F.sum("_n").over(inner))
    )
    holds = lambda rank: F.max(
        F.when((F.col(rank) < F.col("_end")) & (F.col(rank) >= F.col("_end") - F.col("_n")), F.col("_v"))
    )
    found = values.groupBy("_c", "_m").agg(holds("_lo").alias("_a"), holds("_hi").alias("_z"))
    return found.select(
        F.col("_c").alias("cutoff"),
        F.col("_m").alias("column"),
        (F.col("_a") + (F.col("_z") - F.col("_a")) / 2).alias("median"),
    )
