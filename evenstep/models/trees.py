"""Forests and boosted trees through Spark ML, one regressor per step ahead."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from evenstep.errors import ForecastError
from evenstep.schema import Y, YHAT, feature_columns

# The roster's settings. Leaf-wise growth to 31 leaves has no counterpart in Spark ML;
# a depth of five allows at most 32.
PRESETS: dict[str, tuple[str, dict[str, Any]]] = {
    "random_forest": ("forest", {"numTrees": 200, "maxDepth": 12}),
    "boosted_deep": ("gbt", {"maxIter": 300, "maxDepth": 8, "stepSize": 0.05}),
    "boosted_shallow": ("gbt", {"maxIter": 300, "maxDepth": 5, "stepSize": 0.05}),
}
_LEARNERS = {"forest": RandomForestRegressor, "gbt": GBTRegressor}


@dataclass(frozen=True)
class TreeForecaster:
    """Feature order, horizon, and one fitted pipeline that adds a column per step."""

    features: list[str]
    horizon: int
    pipeline: PipelineModel
    hyperparameters: dict[str, Any] = field(default_factory=dict)

    def predict(self, frame: DataFrame) -> DataFrame:
        """Add ``yhat``."""
        absent = sorted(set(self.features) - set(frame.columns))
        if absent:
            raise ForecastError(f"cannot predict: feature(s) {absent} absent")
        steps = [f"_yhat_{h}" for h in range(1, self.horizon + 1)]
        scored = self.pipeline.transform(frame)
        return scored.withColumn(YHAT, F.array(*steps)).drop("_features", *steps)


def fit_trees(
    train: DataFrame,
    kind: str,
    features: Sequence[str] | None = None,
    horizon: int = 24,
    seed: int = 42,
    fits_at_once: int = 4,
    **hyperparameters: Any,
) -> TreeForecaster:
    """Fit ``kind`` (``forest`` or ``gbt``) for each step ahead over the rows of all series.

    Series are pooled, since a learner per series would be a loop on the driver; give one series to have
    one model for it. The assembled vectors are persisted once for all steps (they are recomputed from
    their source if an executor is lost), and a few fits are submitted at a time to fill the cluster.
    """
    if kind not in _LEARNERS:
        raise ForecastError(f"unknown learner {kind!r}; use one of {sorted(_LEARNERS)}")
    names = list(features) if features is not None else feature_columns(train)
    assembler = VectorAssembler(inputCols=names, outputCol="_features")
    labels = [F.element_at(Y, h).alias(f"_y_{h}") for h in range(1, horizon + 1)]
    rows = assembler.transform(train).select("_features", *labels).persist(StorageLevel.MEMORY_AND_DISK)

    def fit(h: int):
        learner = _LEARNERS[kind](
            featuresCol="_features", labelCol=f"_y_{h}", predictionCol=f"_yhat_{h}", seed=seed, **hyperparameters
        )
        return learner.fit(rows)

    try:
        with ThreadPoolExecutor(fits_at_once) as pool:
            models = list(pool.map(fit, range(1, horizon + 1)))
    finally:
        rows.unpersist()
    return TreeForecaster(names, horizon, PipelineModel([assembler, *models]), hyperparameters)


def fit_preset(train: DataFrame, preset: str, horizon: int = 24, **overrides: Any) -> TreeForecaster:
    """Fit a learner of the roster, with its own settings unless overridden."""
    if preset not in PRESETS:
        raise ForecastError(f"unknown preset {preset!r}; use one of {sorted(PRESETS)}")
    kind, settings = PRESETS[preset]
    return fit_trees(train, kind, horizon=horizon, **{**settings, **overrides})
