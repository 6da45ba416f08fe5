"""Clusters of embeddings by exact integer k-means with an equal-average equal-variance search.

By Cauchy-Schwarz two vectors of k components lie at least k * (difference of their
means) ** 2 apart, and at least that plus (difference of their deviations) ** 2, where
a deviation is the distance of a vector from its mean in every component. So centroids
are sorted by their mean; a vector starts at its own mean, goes outward to the next
centroid on either side, passes over those that the deviations rule out, and stops
when the means rule out all that are left. What is left is compared in whole numbers.
Both inequalities are taken with a margin for rounding; only the exact distances decide.

A round reads the stored integers once. Each task sends one row per centroid (count and
sums), so that a cluster of a third of all rows costs as much as any other; the driver
gets one number per centroid and component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasontide.llm.common import stored

#: Integers beyond this would overflow 64-bit distances of 64 components.
LARGEST = 1 << 27
#: Rows compared at a time.
ROWS = 8192
_FAR = np.iinfo(np.int64).max


def _deviation(x: np.ndarray) -> np.ndarray:
    away = x - x.mean(axis=1, keepdims=True)
    return np.sqrt(np.einsum("ij,ij->i", away, away))


class Search:
    """The nearest of some integer centroids, by squared distance and then by number."""

    def __init__(self, centroids: np.ndarray):
        totals = centroids.sum(axis=1)
        self.number = np.argsort(totals, kind="stable")
        self.centroids = centroids[self.number]
        self.totals = totals[self.number]
        self.deviations = _deviation(self.centroids)
        self.compared = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row of ``x``."""
        count, width = self.centroids.shape
        totals, deviations = x.sum(axis=1), _deviation(x)
        best = np.full(len(x), _FAR)
        label = np.full(len(x), count)
        right = np.searchsorted(self.totals, totals)
        left = right - 1
        rows = np.arange(len(x))
        while len(rows):
            below, above = left[rows], right[rows]
            down = np.where(below >= 0, totals[rows] - self.totals[np.maximum(below, 0)], _FAR)
            up = np.where(above < count, self.totals[np.minimum(above, count - 1)] - totals[rows], _FAR)
            leftward, gap = down <= up, np.minimum(down, up)
            bound = gap.astype(float) ** 2 / width
            limit = best[rows] * (1 + 1e-9) + 0.5
            # both sides are at least this far in the mean, and so is all beyond them
            going = (gap < _FAR) & (bound <= limit)
            rows, leftward, bound, limit = rows[going], leftward[going], bound[going], limit[going]
            at = np.where(leftward, below[going], above[going])
            left[rows[leftward]] -= 1
            right[rows[~leftward]] += 1
            close = bound + (deviations[rows] - self.deviations[at]) ** 2 <= limit
            near, at = rows[close], at[close]
            self.compared += len(near)
            apart = x[near] - self.centroids[at]
            distance, number = np.einsum("ij,ij->i", apart, apart), self.number[at]
            better = (distance < best[near]) | ((distance == best[near]) & (number < label[near]))
            best[near[better]], label[near[better]] = distance[better], number[better]
        return label, best


def _rows(column: pa.Array, width: int):
    """Stored integers in runs of ``ROWS`` rows."""
    for at in range(0, len(column), ROWS):
        part = column.slice(at, ROWS)
        yield at, np.frombuffer(b"".join(part.to_pylist()), "<i4").reshape(-1, width).astype(np.int64)


def integers(vectors: DataFrame, width: int = 64, scale: float = 1024.0) -> DataFrame:
    """(vec_id, x): floor(scale * component) of the usable vectors, as little-endian 32-bit integers.

    Usable are vectors of ``width`` components, none null or non-finite. A component
    beyond +-2 ** 27 after scaling is an error, as distances would overflow.
    """
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    usable = F.col("embedding").isNotNull() & (F.size("embedding") == width) & ~F.exists("embedding", bad)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(usable)

    def run(batches):
        for batch in batches:
            x = np.floor(np.asarray(batch.column(1).flatten(), np.float64).reshape(-1, width) * scale)
            if len(x) and np.abs(x).max() > LARGEST:
                raise ValueError(f"components beyond {LARGEST / scale} can't be clustered in 64 bits")
            x = x.astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "x"])

    return rows.mapInArrow(run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, x binary")


def seeds(rows: DataFrame, count: int, salt: str) -> np.ndarray:
    """The ``count`` vectors whose ids, after the salt, have the smallest SHA-256 in lowercase hex.

    Rows without an id come last; rows that repeat an id follow each other by content.
    """
    hashed = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(hashed.asc_nulls_last(), "x").select("x").limit(count).toArrow().column(0).to_pylist()
    return np.array([np.frombuffer(x, "<i4") for x in first], np.int64)


def _round(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Exact floors of the means of the vectors nearest to each centroid; a centroid without any stays."""
    count, width = centroids.shape

    def run(batches):
        search = Search(centroids)
        sums, sizes = np.zeros((count, width), np.int64), np.zeros(count, np.int64)
        for batch in batches:
            for _, x in _rows(batch.column(1), width):
                label, _ = search.nearest(x)
                order = np.argsort(label, kind="stable")
                held, first = np.unique(label[order], return_index=True)
                sums[held] += np.add.reduceat(x[order], first, axis=0)
                sizes += np.bincount(label, minlength=count)
        held = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.astype(np.int32)), pa.array(sizes[held]), pa.array(list(sums[held]), pa.list_(pa.int64()))],
            ["cluster", "n", "sums"],
        )

    parts = rows.mapInArrow(run, "cluster int, n long, sums array<long>")
    totals = parts.select("cluster", "n", F.posexplode("sums").alias("dimension", "s")).groupBy("cluster", "dimension")
    # one row per centroid and component
    moved = centroids.copy()
    for r in totals.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        moved[r["cluster"], r["dimension"]] = r["s"] // r["n"]
    return moved


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of stored integers."""

    def run(batches):
        search = Search(centroids)
        for batch in batches:
            for at, x in _rows(batch.column(1), centroids.shape[1]):
                label, distance = search.nearest(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(x)), pa.array(label.astype(np.int32)), pa.array(distance)],
                    ["vec_id", "cluster", "distance"],
                )

    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def cluster(
    vectors: DataFrame, count: int = 8, rounds: int = 10, width: int = 64, scale: float = 1024.0, salt: str = "3"
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each usable vector of ``vectors`` (vec_id, embedding), and the final centroids.

    Vectors of another width, null ones and those with null or non-finite components
    are left out; rows that repeat an id, and equal rows, each count. Fewer vectors than
    ``count`` give as many centroids. An empty table gives no rows and no centroids.
    """
    rows = stored(integers(vectors, width, scale), "integers")
    centroids = seeds(rows, count, salt)
    if not len(centroids):
        return rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        centroids = _round(rows, centroids)
    return stored(assign(rows, centroids), "clusters"), centroids


def summarised(vectors: DataFrame, **options) -> DataFrame:
    """The clusters of ``cluster`` with their inertia and a digest of their centroid."""
    import hashlib

    rows, centroids = cluster(vectors, **options)
    # one row per centroid
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = rows.sparkSession.createDataFrame(
        [(i, s, sum(sums.values()), digests[i]) for i, s in sums.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return rows.join(facts, "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def oracle(count: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, salt: str = "3") -> str:
    """The same rows by plain SQL: every vector with every centroid."""
    distance = f"CAST(list_sum(list_transform(range(1, {width + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i]))) AS BIGINT)"
    nearest = f"""SELECT v.r, min_by(c.k, {distance} * {count} + c.k) AS k, min({distance}) AS d
        FROM vecs v CROSS JOIN {{}} c GROUP BY v.r"""
    mean = "(sum(v.x[i]) - ((sum(v.x[i]) % count(*)) + count(*)) % count(*)) // count(*)"
    steps = [
        f"""vecs AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id,
            list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings WHERE len(embedding) = {width}
            AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(CAST(e AS DOUBLE)))) = {width})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id)) - 1 AS k, x
            FROM vecs QUALIFY k < {count})""",
    ]
    for n in range(rounds):
        steps.append(f"a{n} AS MATERIALIZED ({nearest.format(f'c{n}')})")
        steps.append(
            f"""c{n + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN (
            SELECT k, list(CAST(m AS BIGINT) ORDER BY i) AS x FROM (SELECT k, i, {mean} AS m FROM a{n} JOIN vecs v USING (r),
            unnest(range(1, {width + 1})) AS t(i) GROUP BY k, i) GROUP BY k) m USING (k))"""
        )
    steps.append(f"last AS MATERIALIZED ({nearest.format(f'c{rounds}')})")
    return f"""WITH {', '.join(steps)} SELECT vec_id, CAST(l.k AS INTEGER) AS "cluster", l.d AS distance,
        CAST(sum(l.d) OVER (PARTITION BY l.k) AS BIGINT) AS cluster_inertia, CAST(sum(l.d) OVER () AS BIGINT) AS inertia,
        sha256(array_to_string(c.x, ',')) AS centroid_sha256
        FROM last l JOIN vecs USING (r) JOIN c{rounds} c ON c.k = l.k"""
