"""Seasonal naive forecast: the same step one season earlier."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window, functions as F

from evenstep.errors import NaiveModelError
from evenstep.functions.stamps import floor_to, stamp_micros, step_micros
from evenstep.operators.blocks import BLOCK, MICROS, PHASE, block_steps, spread
from evenstep.schema import SERIES, TS, VALUE, YHAT, require_panel, require_unique_stamps


def require_season(season: int, horizon: int) -> None:
    if season <= horizon:
        raise NaiveModelError(
            f"season {season} must be longer than the horizon {horizon}, or it reads the future it predicts"
        )


def seasonal_naive(
    scored: DataFrame,
    series: DataFrame,
    horizon: int = 24,
    season: int = 168,
    step: str | timedelta = "h",
    check: bool = True,
    steps_per_block: int | None = None,
) -> DataFrame:
    """Add ``yhat``: for each row at t, the values of ``series`` at t + h - season for h = 1..horizon.

    ``series`` is the whole series, unsplit and unscaled; the lookup crosses splits, never into the
    future. It is exact in time, so a missing stamp leaves a row unanswered. With ``check`` such rows are
    counted and refused, as are repeated stamps in ``series``; otherwise their ``yhat`` is null.

    Scored rows and series rows are stacked and read through one window. Each series row is sent to the
    block of the rows that will read it, one season on, so this is a single shuffle without a join.
    """
    require_season(season, horizon)
    require_panel(scored, NaiveModelError, target=TS)
    require_panel(series, NaiveModelError)
    if check:
        require_unique_stamps(series, NaiveModelError)
    step = step_micros(step)
    width = step * (steps_per_block or block_steps(season))
    micros = stamp_micros(TS)

    # Only stamps a whole number of steps apart can answer each other, hence the remainder in the key.
    phase = F.pmod(F.col(MICROS), F.lit(step))
    asked = scored.withColumn(MICROS, micros).withColumns(
        {BLOCK: floor_to(micros, width), PHASE: phase, "_asked": F.lit(True), "_read": F.lit(None).cast("double")}
    )
    readers = F.sequence(
        floor_to(F.col(MICROS) + (season - horizon) * step, width),
        floor_to(F.col(MICROS) + (season - 1) * step, width),
    )
    held = series.select(SERIES, micros.alias(MICROS), F.col(VALUE).alias("_read")).select(
        SERIES, MICROS, F.explode(readers).alias(BLOCK), phase.alias(PHASE), F.lit(False).alias("_asked"), "_read"
    )
    stacked = spread(asked.unionByName(held, allowMissingColumns=True), SERIES, BLOCK, PHASE)
    spec = Window.partitionBy(SERIES, BLOCK, PHASE).orderBy(MICROS)
    answer = F.collect_list("_read").over(spec.rangeBetween(-(season - 1) * step, -(season - horizon) * step))
    out = (
        stacked.withColumn(YHAT, answer)
        .where(F.col("_asked"))
        .withColumn(YHAT, F.when(F.size(YHAT) == horizon, F.col(YHAT)))
        .drop(MICROS, BLOCK, PHASE, "_asked", "_read")
    )
    if check:
        unanswered = out.agg(F.count_if(F.col(YHAT).isNull())).first()[0]
        if unanswered:
            raise NaiveModelError(f"{unanswered} rows ask for a stamp of last season that the series does not hold")
    return out
