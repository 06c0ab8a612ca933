"""Forecast error over rows of ``y`` and ``yhat`` arrays, in the units they are in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from evenstep.schema import Y, YHAT


def _squared_errors(y: str, yhat: str) -> Column:
    return F.zip_with(y, yhat, lambda a, b: (b - a) * (b - a))


def rmse(frame: DataFrame, by: Sequence[str] = (), y: str = Y, yhat: str = YHAT) -> DataFrame:
    """Root mean squared error over all rows and steps, per group of ``by`` or over everything.

    Each row adds up its own steps, so arrays are never exploded. Rows left without a forecast cannot be
    scored; ``n`` counts the steps that were, ``unscored`` the rows that were not.
    """
    row_error = F.aggregate(_squared_errors(y, yhat), F.lit(0.0), lambda total, e: total + e)
    return (
        frame.groupBy(*by)
        .agg(F.sum(row_error).alias("_sse"), F.sum(F.when(row_error.isNotNull(), F.size(y))).alias("n"), F.count_if(row_error.isNull()).alias("unscored"))
        .select(*by, "n", "unscored", F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"))
    )


def scores(frame: DataFrame, forecasts: dict[str, str], y: str = Y) -> DataFrame:
    """``[model, n, unscored, rmse]`` of forecasts that stand side by side, model to column, in one pass over the rows.

    Every task sends one row with all models' sums.
    """
    cells = []
    for model, column in forecasts.items():
        row_error = F.aggregate(_squared_errors(y, column), F.lit(0.0), lambda total, e: total + e)
        scored = F.sum(F.when(row_error.isNotNull(), F.size(y)))
        error = F.sqrt(F.sum(row_error) / scored).alias("rmse")
        cells.append(F.struct(F.lit(model).alias("model"), scored.alias("n"), F.count_if(row_error.isNull()).alias("unscored"), error))
    return frame.agg(F.array(*cells).alias("_cells")).select(F.inline("_cells"))


def rmse_by_step(
    frame: DataFrame, horizon: int, by: Sequence[str] = (), y: str = Y, yhat: str = YHAT
) -> DataFrame:
    """The same per step ahead. One partial row per task and group holds a sum for each step.

    ``n`` counts the rows scored, ``rmse``'s ``unscored`` those that were not.
    """
    def error(h: int) -> Column:
        gap = F.element_at(yhat, h) - F.element_at(y, h)
        return F.sum(gap * gap)

    sums = frame.groupBy(*by).agg(F.array(*[error(h) for h in range(1, horizon + 1)]).alias("_sse"), F.count(yhat).alias("n"))
    return sums.select(*by, "n", F.posexplode("_sse").alias("_pos", "_sum")).select(
        *by,
        (F.col("_pos") + 1).cast("int").alias("step"),
        "n",
        F.sqrt(F.col("_sum") / F.col("n")).alias("rmse"),
    )


def improvement_over(scores: DataFrame, baseline: str, by: Sequence[str] = ()) -> DataFrame:
    """Add ``improvement_pct``: rounded percent by which each model's ``rmse`` undercuts the baseline's.

    ``scores`` holds one row per model and group of ``by``, so a group is as small as the roster.
    """
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    bar = F.max(F.when(F.col("model") == baseline, F.col("rmse"))).over(group)
    return scores.withColumn("improvement_pct", F.round((1.0 - F.col("rmse") / bar) * 100.0).cast("int"))
