"""Least squares per series, one output per step ahead, by a QR decomposition merged in a tree.

The triangle of a tall matrix stands for all its rows: stacking the triangles of its parts and decomposing the stack
gives the triangle of the whole. So each task sends a triangle of features by features, whatever it read, and the
condition of the problem is never squared, as it would be by cross products.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from evenstep.errors import ForecastError
from evenstep.schema import SERIES, Y, YHAT, feature_columns, join_on
from evenstep.sources.storage import settle

_SALTS = 64
#: Series whose sums one task holds before passing them on.
_HELD = 2_048
#: Singular values below this share of the largest are taken for 0.
_RANK_TOLERANCE = 1e-12
#: Rows that a task gathers before it reduces them to a triangle.
_TALL = 8_192

# The functions below that run in Python workers travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class LinearForecaster:
    """Feature order, horizon, and ``[series_id, intercept ARRAY, weights ARRAY<ARRAY>]`` rows."""

    features: list[str]
    horizon: int
    coefficients: DataFrame

    def predict(self, frame: DataFrame) -> DataFrame:
        """Add ``yhat``. Feature order is the fitted one, whatever the order of the frame."""
        absent = sorted(set(self.features) - set(frame.columns))
        if absent:
            raise ForecastError(f"cannot predict: feature(s) {absent} absent")
        # One product of a matrix and a vector over arrays: spelt out, five hundred terms outgrow a compiled method.
        row = F.array(*[F.col(f"`{name}`").cast("double") for name in self.features])
        steps = F.expr(
            "transform(_weights, (w, h) -> aggregate(zip_with(w, _row, (a, b) -> a * b), _intercept[h], (total, term) -> total + term))"
        )
        known = self.coefficients.select(SERIES, F.col("intercept").alias("_intercept"), F.col("weights").alias("_weights"))
        joined = join_on(frame, known, [SERIES], "left").withColumn("_row", row)
        return joined.withColumn(YHAT, steps).drop("_intercept", "_weights", "_row")


def fit_linear(train: DataFrame, features: Sequence[str] | None = None, horizon: int = 24) -> LinearForecaster:
    """Fit ``y`` on the features, one model per series, ordinary least squares with an intercept.

    Pass a stored frame: it is read twice. The first pass takes means and deviations, the second reduces
    standardised rows to triangles in each task; triangles of one series meet in two salted rounds, and the solve
    sees one triangle, on whichever task holds it. Of equally good solutions the one of least norm is taken.
    """
    names = list(features) if features is not None else feature_columns(train)
    p = len(names)

    def listed(calls: list[str], name: str) -> Column:
        return F.expr(f"array({', '.join(calls)})").alias(name)

    moments = settle(
        train.groupBy(SERIES).agg(
            listed([f"avg(`{c}`)" for c in names], "x_mean"),
            listed([f"coalesce(stddev_pop(`{c}`), 0D)" for c in names], "x_std"),
            listed([f"avg({Y}[{h}])" for h in range(horizon)], "y_mean"),
        )
    )
    standard = [
        f"CASE WHEN x_std[{i}] > 0 THEN (`{c}` - x_mean[{i}]) / x_std[{i}] ELSE 0D END AS x{i}" for i, c in enumerate(names)
    ]
    centred = [f"{Y}[{h}] - y_mean[{h}] AS y{h}" for h in range(horizon)]
    rows = join_on(train, moments, [SERIES]).selectExpr(SERIES, *standard, *centred)

    triangle = f"{SERIES} string, triangle array<double>"
    partial = rows.mapInPandas(lambda batches: _triangles(batches, p), triangle)
    salted = partial.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(_SALTS)))
    halfway = salted.groupBy(SERIES, "_salt").applyInPandas(lambda group: _merged(group, p, horizon), triangle)
    solved = join_on(halfway, moments, [SERIES]).groupBy(SERIES).applyInPandas(
        lambda group: _solve(group, p, horizon),
        f"{SERIES} string, intercept array<double>, weights array<array<double>>",
    )
    return LinearForecaster(names, horizon, settle(solved))


def _reduced(rows: np.ndarray, p: int) -> np.ndarray:
    """The first ``p`` rows of the triangle of ``rows`` (features, then outputs); all that the solution depends on."""
    return np.linalg.qr(rows, mode="r")[:p]


def _triangles(batches: Iterator[pd.DataFrame], p: int) -> Iterator[pd.DataFrame]:
    held: dict[str | None, list[np.ndarray]] = {}
    waiting: dict[str | None, int] = {}

    def gathered() -> pd.DataFrame:
        return pd.DataFrame({SERIES: list(held), "triangle": [_reduced(np.vstack(m), p).ravel() for m in held.values()]})

    for batch in batches:
        matrix = batch.iloc[:, 1:].to_numpy(dtype=float)
        for series, rows in batch.groupby(SERIES, sort=False, dropna=False).indices.items():
            series = None if pd.isna(series) else series
            held.setdefault(series, []).append(matrix[rows])
            waiting[series] = waiting.get(series, 0) + len(rows)
            if waiting[series] >= _TALL:
                held[series] = [_reduced(np.vstack(held[series]), p)]
                waiting[series] = 0
        if len(held) > _HELD or sum(waiting.values()) > 8 * _TALL:
            yield gathered()
            held, waiting = {}, {}
    if held:
        yield gathered()


def _stacked(group: pd.DataFrame, p: int, horizon: int) -> np.ndarray:
    return _reduced(np.concatenate(group["triangle"].to_list()).reshape(-1, p + horizon), p)


def _merged(group: pd.DataFrame, p: int, horizon: int) -> pd.DataFrame:
    return pd.DataFrame({SERIES: [group[SERIES].iloc[0]], "triangle": [_stacked(group, p, horizon).ravel()]})


def _solve(group: pd.DataFrame, p: int, horizon: int) -> pd.DataFrame:
    first = group.iloc[0]
    x_mean, x_std, y_mean = (np.asarray(first[c], dtype=float) for c in ("x_mean", "x_std", "y_mean"))
    triangle = _stacked(group, p, horizon)
    left, values, right = np.linalg.svd(triangle[:, :p], full_matrices=True)
    size = np.zeros(p)
    size[: len(values)] = values
    kept = size > _RANK_TOLERANCE * max(size.max(initial=0.0), np.finfo(float).tiny)
    scale = np.where(x_std > 0, x_std, 1.0)[:, None]
    count = int(kept.sum())
    turned = (left[:, :count].T @ triangle[:, p:]) / size[:count, None]
    weights = right[:count].T @ turned / scale
    # Of all equally good solutions take the one of least norm in the units of the columns.
    free = right[count:].T / scale
    if free.shape[1]:
        weights -= free @ (np.linalg.pinv(free) @ weights)
    intercept = y_mean - x_mean @ weights
    return pd.DataFrame(
        {SERIES: [first[SERIES]], "intercept": [intercept], "weights": [list(weights.T)]}
    )
