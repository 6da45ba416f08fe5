"""Calibrators of many cutoffs and input sets from sums per season.

A calibrator imputes medians, standardises and solves a ridge system.  All of it
follows from sums of products: with z the known value of an input (else 0) and m
its missing flag, the imputed input is z + median * m, whatever the median is.  So
one pass keeps, per season, the products of (z, m, stage flags, target, 1); these
add up over seasons, and a cutoff takes the sums of the seasons before it, its own
medians and a small solve.  Leaving out inputs takes rows and columns away.

Values are counted from a centre, so that the sums of squares keep their digits;
the centre cancels out and does not change a result.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasontide.functions import scalars as S
from seasontide.functions.quantiles import prefix_medians
from seasontide.operators import termination as T


@dataclass(frozen=True)
class RidgeCalibrator:
    """Median impute, standardise, one-hot and ridge, as plain numbers."""

    features: tuple[str, ...]
    medians: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]
    categories: tuple[str, ...]
    category_weights: tuple[float, ...]
    intercept: float

    def expression(self) -> Column:
        total = F.lit(self.intercept)
        for c, median, mean, scale, weight in zip(
            self.features, self.medians, self.means, self.scales, self.weights
        ):
            value = F.coalesce(S.null_if_nan(F.col(c).cast("double")), F.lit(median))
            total = total + (value - mean) / scale * weight
        for category, weight in zip(self.categories, self.category_weights):
            total = total + F.when(F.col("stage") == category, F.lit(weight)).otherwise(0.0)
        return total

    def transform(self, df: DataFrame, output: str = "learned_days_remaining") -> DataFrame:
        return df.withColumn(output, self.expression())

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> RidgeCalibrator:
        return cls(
            **{k: tuple(v) if isinstance(v, list) else v for k, v in json.loads(text).items()}
        )


@dataclass(frozen=True)
class SeasonSums:
    """Per season: products, least and greatest values; per cutoff: medians of the seasons before it."""

    features: tuple[str, ...]
    stages: tuple[str, ...]
    centres: np.ndarray
    target_centre: float
    products: Mapping[int, np.ndarray]
    lows: Mapping[int, np.ndarray]
    highs: Mapping[int, np.ndarray]
    medians: Mapping[int, np.ndarray]
    window: int | None = None

    @property
    def cutoffs(self) -> list[int]:
        return sorted(self.medians)


def _seen_at(season: int, cutoff: int, window: int | None) -> bool:
    return season < cutoff and (window is None or season >= cutoff - window)


def _table(batch: pa.RecordBatch, first: int, last: int) -> np.ndarray:
    """Columns as doubles, NULL as NaN."""
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(first, last)])


def season_sums(
    df: DataFrame,
    season: str,
    target: str,
    features: Sequence[str] = T.NUMERIC_FEATURES,
    cutoffs: Sequence[int] | None = None,
    window: int | None = None,
) -> SeasonSums:
    """Sums of the rows with a target, for calibrators of each cutoff (all seasons and the one after).

    A cutoff sees the seasons before it, with ``window`` only that many of them.
    ``df`` is read three times, so pass a stored table.  Rows without a season are
    left out.  The driver gets one matrix per season and one median per cutoff and
    input; tasks send one row per season that they saw.
    """
    features = list(features)
    known = df.where(F.col(target).isNotNull() & F.col(season).isNotNull()).select(
        F.col(season).cast("int").alias("_season"),
        F.col("stage").cast("string").alias("stage"),
        F.col(target).cast("double").alias("_y"),
        *[S.null_if_nan(F.col(c).cast("double")).alias(c) for c in features],
    )
    # one row per season; stages are the target ids
    seen = (
        known.groupBy("_season")
        .agg(F.avg("_y").alias("_y"), F.collect_set("stage").alias("stages"), *[F.avg(c).alias(c) for c in features])
        .collect()
    )
    if cutoffs is None:
        seasons = sorted(r[0] for r in df.select(F.col(season).cast("int")).distinct().collect() if r[0] is not None)
        cutoffs = [*seasons, seasons[-1] + 1] if seasons else []
    if window is not None and window <= 0:
        raise ValueError("window must be positive")
    cutoffs = [c for c in cutoffs if any(_seen_at(r["_season"], c, window) for r in seen)]
    stages = sorted({s for r in seen for s in r["stages"]})
    middle = lambda values: float(np.mean(values)) if values else 0.0
    centres = np.array([middle([r[c] for r in seen if r[c] is not None]) for c in features])
    target_centre = middle([r["_y"] for r in seen])
    n, size = len(features), 2 * len(features) + len(stages) + 2

    def run(batches):
        products, lows, highs = {}, {}, {}
        for batch in batches:
            years = batch.column(0).to_numpy()
            stage = batch.column(1).to_pylist()
            y = batch.column(2).to_numpy()
            x = _table(batch, 3, 3 + n)
            missing = np.isnan(x)
            flags = [[float(s == known) for known in stages] for s in stage]
            rows = np.hstack(
                [
                    np.where(missing, 0.0, x - centres),
                    missing,
                    np.array(flags).reshape(len(x), len(stages)),
                    (y - target_centre)[:, None],
                    np.ones((len(x), 1)),
                ]
            )
            for year in np.unique(years).tolist():
                mine = years == year
                part = rows[mine]
                products[year] = products.get(year, 0) + part.T @ part
                low = np.fmin.reduce(x[mine], axis=0)
                high = np.fmax.reduce(x[mine], axis=0)
                lows[year] = np.fmin(lows.get(year, low), low)
                highs[year] = np.fmax(highs.get(year, high), high)
        for year, matrix in products.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([year], pa.int32()),
                    pa.array([matrix.ravel()], pa.list_(pa.float64())),
                    pa.array([lows[year]], pa.list_(pa.float64())),
                    pa.array([highs[year]], pa.list_(pa.float64())),
                ],
                ["season", "products", "low", "high"],
            )

    parts = known.mapInArrow(run, "season int, products array<double>, low array<double>, high array<double>")
    cells = F.arrays_zip("products", "low", "high")
    # NaN stands for an input that a task never saw; arrays are padded to the longest
    summed = (
        parts.select("season", F.posexplode(cells).alias("at", "cell"))
        .groupBy("season", "at")
        .agg(
            F.sum("cell.products").alias("products"),
            F.min(S.null_if_nan(F.col("cell.low"))).alias("low"),
            F.max(S.null_if_nan(F.col("cell.high"))).alias("high"),
        )
        .collect()
    )
    products = {r["_season"]: np.zeros(size * size) for r in seen}
    lows = {r["_season"]: np.full(n, np.nan) for r in seen}
    highs = {r["_season"]: np.full(n, np.nan) for r in seen}
    for r in summed:
        products[r["season"]][r["at"]] = r["products"]
        if r["at"] < n and r["low"] is not None:
            lows[r["season"]][r["at"]] = r["low"]
            highs[r["season"]][r["at"]] = r["high"]
    found = {c: np.full(n, np.nan) for c in cutoffs}
    for r in prefix_medians(known, "_season", features, cutoffs, window).collect():
        found[r["cutoff"]][r["column"]] = r["median"]
    return SeasonSums(
        tuple(features),
        tuple(stages),
        centres,
        target_centre,
        {s: p.reshape(size, size) for s, p in products.items()},
        lows,
        highs,
        found,
        window,
    )


def solve(
    sums: SeasonSums, cutoff: int, alpha: float, features: Sequence[str] | None = None, with_stage: bool = True
) -> RidgeCalibrator:
    """The calibrator of the seasons that ``cutoff`` sees, on some of the inputs."""
    wanted = set(sums.features if features is None else features)
    medians = sums.medians[cutoff]
    before = [s for s in sums.products if _seen_at(s, cutoff, sums.window)]
    total = sum(sums.products[s] for s in before)
    n, stages = len(sums.features), len(sums.stages)
    used = [i for i, c in enumerate(sums.features) if c in wanted and not np.isnan(medians[i])]
    shown = [j for j in range(stages) if with_stage and total[2 * n + j, -1] > 0]
    size = len(used) + len(shown) + 2
    pick = np.zeros((size, len(total)))
    for row, i in enumerate(used):
        pick[row, i], pick[row, n + i] = 1.0, medians[i] - sums.centres[i]
    for row, j in enumerate(shown, len(used)):
        pick[row, 2 * n + j] = 1.0
    pick[-2, -2] = pick[-1, -1] = 1.0
    moments = pick @ total @ pick.T
    count = moments[-1, -1]
    means = moments[:-1, -1] / count
    centred = moments[:-1, :-1] - count * np.outer(means, means)
    low = np.fmin.reduce([sums.lows[s] for s in before], axis=0)
    high = np.fmax.reduce([sums.highs[s] for s in before], axis=0)
    scales = np.ones(size - 2)
    for row, i in enumerate(used):
        deviation = np.sqrt(max(centred[row, row], 0.0) / count)
        constant = low[i] == high[i]
        scales[row] = 1.0 if constant or deviation <= 1e-12 else deviation
    gram = centred[:-1, :-1] / np.outer(scales, scales)
    weights = np.linalg.solve(gram + alpha * np.eye(size - 2), centred[:-1, -1] / scales)
    at = len(used)
    return RidgeCalibrator(
        features=tuple(sums.features[i] for i in used),
        medians=tuple(float(medians[i]) for i in used),
        means=tuple((means[:at] + sums.centres[used]).tolist()),
        scales=tuple(scales[:at].tolist()),
        weights=tuple(weights[:at].tolist()),
        categories=tuple(sums.stages[j] for j in shown),
        category_weights=tuple(weights[at:].tolist()),
        intercept=float(means[-1] + sums.target_centre - weights[at:] @ means[at:-1]),
    )
