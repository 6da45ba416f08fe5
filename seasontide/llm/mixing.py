"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time u in [0, 1]: straight
lines between points. Its integral W(u) is the share of the source's tokens
that training has asked for by u. A document that begins c tokens into its
source's order stands where the source's cumulative demand reaches c, so its
position is the inverse of the integral. The corpus in training order is the
documents range-sorted by position. Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasontide.llm.common import stored, word_count

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Points (u, weight) of the schedules, repeating in the same order: even, late and early sources.
SCHEDULES = (
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 0.5), (1.0, 2.5)),
    ((0.0, 2.0), (1.0, 0.25)),
)
#: Documents that one running total sees; further ones go to another range of the order.
ROWS_PER_RANGE = 20_000


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = 150, most: int = 2
) -> DataFrame:
    """(source, rank, source_size, target) from rows (source, size).

    The sources share ``percent`` of all sizes by weight, and stop at ``most``
    times their size; what is over is shared again by weight until none is above.
    That ends at target = min(cap, weight * level); the level is found by sorting
    the sources by cap / weight. Sums are whole numbers, so reruns agree. Null is
    a source and comes last. One row per source is gathered, nothing else.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = totals.withColumn("rank", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), F.col("rank") % len(weights) + 1)
    listed = listed.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    every = Window.partitionBy(F.lit(0))
    # integer comparison of cap / weight: cross-multiplied by the product of the weights
    scale = 1
    for w in weights:
        scale *= w
    by_need = Window.orderBy(F.col("cap") * (F.lit(scale) / F.col("weight")).cast("long"), "rank")
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        listed.withColumn("total", F.sum("source_size").over(every) * percent / 100)
        .withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("heft", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        # a source is below its cap from the first one on whose share is under it
        .withColumn("under", F.col("rest") * F.col("weight") <= F.col("cap") * F.col("heft"))
    )
    first = F.min(F.when(F.col("under"), F.struct("cap_order", "rest", "heft"))).over(every)
    level = level.withColumn("cap_order", F.row_number().over(by_need)).withColumn("first", first)
    target = F.when(
        F.col("first").isNull() | (F.col("cap_order") < F.col("first.cap_order")), F.col("cap").cast("double")
    ).otherwise(F.col("first.rest") * F.col("weight") / F.col("first.heft"))
    return level.select("source", "rank", "source_size", target.cast("double").alias("target"))


def inverse_demand(share: Column, points: Sequence[tuple[float, float]]) -> Column:
    """Training time at which the integral of a schedule reaches ``share`` of its whole."""
    pieces, area = [], 0.0
    for (u0, w0), (u1, w1) in zip(points, points[1:]):
        pieces.append((u0, u1, w0, w1, area))
        area += (w0 + w1) / 2 * (u1 - u0)
    result = F.lit(points[-1][0])
    for u0, u1, w0, w1, begun in reversed(pieces):
        need = share * area - F.lit(begun)
        slope = (w1 - w0) / (u1 - u0)
        # w0 * x + slope / 2 * x^2 = need, in the form that also holds for slope 0
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * need, F.lit(0.0)))
        inside = F.lit(u0) + F.when(need > 0, 2 * need / (F.lit(w0) + root)).otherwise(0.0)
        end = begun + (w0 + w1) / 2 * (u1 - u0)
        result = F.when(share * area <= F.lit(end), inside).otherwise(result)
    return F.least(result, F.lit(1.0))


def mix(
    documents: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    percent: int = 150,
    most: int = 2,
    schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    keep: Sequence[str] = (),
    seat: str | None = None,
) -> DataFrame:
    """Plan the mix: one row per document.

    Returns doc_id, ``keep``, size, source_size, target, taken and positions (one
    training time per pass in which the document is read, up to ``most``). A
    source's documents stand in the order of a digest of their ids; pass p reads
    words p * source_size to (p + 1) * source_size of the target, and the document
    on the target's edge is read up to it. So the taken words of a source are its
    target, rounded down, and no document is taken more than ``most`` times.

    A null or empty text has size 0 and is taken 0 words, at its place. Rows that
    repeat an id are separate documents. An empty table gives no rows. Other
    columns are left out unless named in ``keep``. ``seat`` names a column that
    tells all documents apart: the place in the source's order.

    Running totals: a document's range of the digest is numbered by its leading
    digits, as many as the largest source needs, so that a hot source is split
    over tasks; range totals are summed over one row per range.
    """
    named = documents.select(
        "doc_id",
        "source",
        *[F.col(c) for c in keep],
        word_count(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("place"),
        F.xxhash64("text").alias("text_place"),
    )
    sizes = stored(named, "sizes")
    largest = sizes.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    digits = 1
    while largest > ROWS_PER_RANGE * 16**digits and digits < 8:
        digits += 1
    sizes = sizes.withColumn("range", F.substring("place", 1, digits))
    ranges = sizes.groupBy("source", "range").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        F.col("source").alias("s"),
        F.col("range").alias("r"),
        F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"),
    )
    targets = source_targets(sizes, weights, percent, most).withColumnRenamed("source", "t")
    ranges = ranges.join(targets, F.col("s").eqNullSafe(F.col("t"))).drop("t")
    standing = Window.partitionBy("source", "range").orderBy("place", "doc_id", "text_place", "size")
    inside = standing.rowsBetween(Window.unboundedPreceding, -1)
    if seat is not None:
        sizes = sizes.withColumn("number", F.row_number().over(standing))
    placed = sizes.withColumn("own", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(
        ranges, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r"))
    )
    begin = F.col("base") + F.col("own")
    whole = F.floor("target")
    reads = [
        F.greatest(F.least(F.col("size"), whole - F.col("source_size") * p - begin), F.lit(0)) for p in range(most)
    ]
    taken = reads[0]
    for more in reads[1:]:
        taken = taken + more
    positions = []
    for p in range(most):
        share = (begin + F.col("source_size") * p) / F.when(F.col("target") > 0, F.col("target"))
        when = F.lit(None).cast("double")
        for i, points in enumerate(schedules):
            when = F.when(F.col("rank") % len(schedules) == i, inverse_demand(share, points)).otherwise(when)
        positions.append(F.when(reads[p] > 0, when))
    return placed.select(
        "doc_id",
        *keep,
        "size",
        "source_size",
        "target",
        taken.cast("long").alias("taken"),
        F.array_compact(F.array(*positions)).alias("positions"),
        *([F.struct("rank", "range", "number").alias(seat)] if seat is not None else []),
    )


def reads(plan: DataFrame) -> DataFrame:
    """One row per read of a document, with its ``position`` and its ``words`` (the last read may be cut).

    Documents that the mix doesn't take have no row.
    """
    rows = plan.select("*", F.posexplode("positions").alias("pass", "position")).drop("positions")
    return rows.withColumn("words", F.least("size", F.col("taken") - F.col("pass") * F.col("size"))).drop("pass")


def training_order(plan: DataFrame, seat: str) -> DataFrame:
    """All reads of a plan with seats, range-sorted by training time and stored.

    One row per read: ``seat``, doc_id, size, source_size, target, its ``pass``, ``position``
    and ``words``. Documents that the mix doesn't take have one row without a pass, ahead of all.
    """
    rows = plan.select("*", F.posexplode_outer("positions").alias("pass", "position")).drop("positions")
    words = F.when(F.col("pass").isNull(), F.lit(0)).otherwise(
        F.least("size", F.col("taken") - F.col("pass") * F.col("size"))
    )
    return stored(in_order(rows.withColumn("words", words).drop("taken"), "doc_id", seat), "order")


def read_back(order: DataFrame, seat: str, most: int = 2) -> DataFrame:
    """The plan as its stored training order has it: one row per document, ``positions`` by pass."""
    at = [F.max(F.when(F.col("pass") == p, F.col("position"))) for p in range(most)]
    return order.groupBy(seat, "doc_id", "size", "source_size", "target").agg(
        F.sum("words").cast("long").alias("taken"), F.array_compact(F.array(*at)).alias("positions")
    ).drop(seat)


def in_order(rows: DataFrame, *ties: str) -> DataFrame:
    """Rows range-sorted by their training time; ties stand in the order of ``ties``."""
    return rows.repartitionByRange("position", *ties).sortWithinPartitions("position", *ties)


def _inverse_sql(share: str, points: Sequence[tuple[float, float]]) -> str:
    """``inverse_demand`` for the oracle, written out in SQL."""
    area = sum((w0 + w1) / 2 * (u1 - u0) for (u0, w0), (u1, w1) in zip(points, points[1:]))
    cases, begun = [], 0.0
    for (u0, w0), (u1, w1) in zip(points, points[1:]):
        need, end = f"({share} * {area} - {begun})", begun + (w0 + w1) / 2 * (u1 - u0)
        root = f"sqrt(greatest({w0 * w0}::DOUBLE + {2 * (w1 - w0) / (u1 - u0)}::DOUBLE * {need}, 0))"
        cases.append(f"WHEN {share} * {area} <= {end} THEN {u0} + 2 * greatest({need}, 0) / ({w0}::DOUBLE + {root})")
        begun = end
    return f"least(CASE {' '.join(cases)} ELSE {points[-1][0]} END, 1.0)::DOUBLE"


def _position_sql(begins: str) -> str:
    share = f"(({begins})::DOUBLE / target)"
    cases = [f"WHEN rank % {len(SCHEDULES)} = {i} THEN {_inverse_sql(share, x)}" for i, x in enumerate(SCHEDULES)]
    return f"round(CASE {' '.join(cases)} END, 6)"


ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, md5(CAST(doc_id AS VARCHAR)) AS place,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM sizes GROUP BY source),
listed AS (SELECT *, [3, 1, 2][rank % 3 + 1] AS weight, 2 * source_size AS cap FROM totals),
levels AS (
  SELECT *, sum(source_size) OVER () * 1.5 - coalesce(sum(cap) OVER b, 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS heft,
    row_number() OVER (ORDER BY cap * (6 // weight), rank) AS cap_order
  FROM listed WINDOW b AS (ORDER BY cap * (6 // weight), rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
first AS (SELECT rest, heft, cap_order AS since FROM levels WHERE rest * weight <= cap * heft ORDER BY cap_order LIMIT 1),
targets AS (
  SELECT source, source_size, rank,
    CASE WHEN since IS NULL OR cap_order < since THEN cap::DOUBLE
         ELSE first.rest::DOUBLE * weight::DOUBLE / first.heft::DOUBLE END AS target
  FROM levels LEFT JOIN first ON true),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.rank, floor(t.target)::BIGINT AS whole,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY place, s.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (greatest(least(size, whole - begins), 0) + greatest(least(size, whole - source_size - begins), 0))::BIGINT AS taken,
  CASE WHEN least(size, whole - begins) > 0 THEN FIRST END AS position,
  CASE WHEN least(size, whole - source_size - begins) > 0 THEN SECOND END AS second_position
FROM placed
""".replace("FIRST", _position_sql("begins")).replace("SECOND", _position_sql("begins + source_size"))
