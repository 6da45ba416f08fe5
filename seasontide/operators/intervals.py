"""Prediction intervals from errors that no model has seen.

Bagged trees: tree t trains on every row as often as ``bag_count`` says, a Poisson
count from a hash of the row's key, so that bags need no shuffle, agree between
reruns, and are known again when the row is scored.  A row's out-of-bag prediction
is the mean of the trees that missed it; its error calibrates the interval.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasontide.functions import scalars as S
from seasontide.functions.checkpoints import reliable
from seasontide.functions.quantiles import exact_percentiles


def _poisson_steps(mean: float = 1.0, digits: float = 1e-9) -> list[float]:
    """Cumulative chances of 0, 1, 2, ... until nothing is left."""
    steps, term, total, k = [], math.exp(-mean), 0.0, 0
    while total < 1.0 - digits:
        total += term
        steps.append(total)
        k += 1
        term *= mean / k
    return steps


def bag_count(keys: Sequence[str], tree: int) -> Column:
    """How often a row is in the bag of a tree: Poisson with mean 1, from the MD5 of its key and the tree's number."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.lit(str(tree)))
    share = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)
    count = F.lit(0)
    for step in _poisson_steps():
        count = count + (share >= step).cast("int")
    return count


@dataclass(frozen=True)
class BaggedTrees:
    """Trees with the keys that say which rows each of them saw; None for a tree whose bag is empty."""

    trees: tuple
    features: tuple[str, ...]
    keys: tuple[str, ...]

    def _votes(self, df: DataFrame) -> tuple[DataFrame, list[Column]]:
        known = F.lit(True)
        for c in self.features:
            known = known & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        typed = df.withColumns({f"_f_{c}": S.number(F.col(c)) for c in self.features})
        out = VectorAssembler(
            inputCols=[f"_f_{c}" for c in self.features], outputCol="_features", handleInvalid="keep"
        ).transform(typed)
        for i, tree in enumerate(self.trees):
            if tree is None:
                continue
            copy = tree.copy()
            copy.setPredictionCol(f"_t{i}")
            copy.setFeaturesCol("_features")
            out = copy.transform(out)
        return out, [(i, F.when(known, F.col(f"_t{i}"))) for i, tree in enumerate(self.trees) if tree is not None]

    def _drop(self, df: DataFrame) -> DataFrame:
        return df.drop("_features", *[f"_f_{c}" for c in self.features], *[f"_t{i}" for i in range(len(self.trees))])

    def predict(self, df: DataFrame, output: str = "pred") -> DataFrame:
        """Mean of all trees; NULL where a feature is missing or there is no tree."""
        out, votes = self._votes(df)
        if not votes:
            return self._drop(out.withColumn(output, F.lit(None).cast("double")))
        total = votes[0][1]
        for _, vote in votes[1:]:
            total = total + vote
        return self._drop(out.withColumn(output, total / len(votes)))

    def out_of_bag(self, df: DataFrame, output: str = "oob") -> DataFrame:
        """Mean of the trees that missed the row, and their number; NULL where every tree saw it."""
        out, votes = self._votes(df)
        total, missed = F.lit(0.0), F.lit(0)
        for i, vote in votes:
            free = bag_count(self.keys, i) == 0
            total = total + F.when(free, vote).otherwise(0.0)
            missed = missed + free.cast("int")
        out = out.withColumn(f"{output}_trees", missed)
        return self._drop(out.withColumn(output, F.when(F.col(f"{output}_trees") > 0, total / F.col(f"{output}_trees"))))


def fit_bagged(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    keys: Sequence[str],
    trees: int = 50,
    params: Mapping | None = None,
) -> BaggedTrees:
    """Regression trees on Poisson bags of the rows with all features and a label.  Pass a stored table: each tree reads it.

    A bag without a row has no tree.
    """
    typed = df.select(
        *dict.fromkeys(keys), *[S.number(F.col(c)).alias(f"_f_{c}") for c in features], F.col(label).cast("double").alias("_y")
    ).where(F.col("_y").isNotNull())
    rows = VectorAssembler(
        inputCols=[f"_f_{c}" for c in features], outputCol="_features", handleInvalid="skip"
    ).transform(typed)
    chosen = {"maxDepth": 10, "seed": 42, **(params or {})}
    fitted = []
    for i in range(trees):
        bag = rows.withColumn("_bag", bag_count(keys, i).cast("double")).where("_bag > 0")
        regressor = DecisionTreeRegressor(featuresCol="_features", labelCol="_y", weightCol="_bag", **chosen)
        fitted.append(None if bag.isEmpty() else regressor.fit(bag))
    return BaggedTrees(tuple(fitted), tuple(features), tuple(keys))


def interval_width(errors: DataFrame, alpha: float, by: Sequence[str] = ()) -> DataFrame:
    """(``by``, width, n_errors): the exact (1 - alpha) quantile of the absolute errors (column error); NULL ones are left out."""
    known = errors.where(F.col("error").isNotNull()).select(*by, F.abs("error").alias("_e"))
    widths = exact_percentiles(known, list(by), {"width": ("_e", 1.0 - alpha)})
    counts = known.groupBy(*by).agg(F.count(F.lit(1)).alias("n_errors"))
    if not by:
        return counts.withColumn("width", widths.scalar())
    return widths.join(counts, list(by))


def bagged_interval(
    model: BaggedTrees, training: DataFrame, df: DataFrame, label: str, alpha: float, pred: str = "pred"
) -> DataFrame:
    """Predictions of ``df`` with an interval from the out-of-bag errors of the training rows."""
    # one narrow column, stored: the percentile reads it more than once
    errors = reliable(model.out_of_bag(training).select((F.col("oob") - F.col(label)).alias("error")))
    width = interval_width(errors, alpha).select("width").scalar()
    out = model.predict(df, pred).withColumn("_w", width)
    return out.withColumns(
        {f"{pred}_lower": F.col(pred) - F.col("_w"), f"{pred}_upper": F.col(pred) + F.col("_w")}
    ).drop("_w")


# ---------------------------------------------------------------- monotone audit


def thresholds(model: PipelineModel, feature: int) -> list[float]:
    """All values at which some tree of the ensemble splits a feature, ascending."""
    stage = model.stages[-1]
    # a leaf-free text form of all trees; numbers are printed with all digits
    found = re.findall(rf"If \(feature {feature} <= ([-+.\dE]+)\)", stage.toDebugString)
    return sorted({float(x) for x in found})


def steps(values: Sequence[float]) -> list[float]:
    """One value of each piece between the thresholds: a tree sends x <= threshold to the left."""
    return [*values, math.nextafter(values[-1], math.inf)] if values else []
