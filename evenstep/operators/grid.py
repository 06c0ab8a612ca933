"""The complete time grid of each series, and what is missing from it."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from evenstep.errors import FeatureError
from evenstep.functions.stamps import shift_stamp, stamp_micros, step_micros
from evenstep.operators.blocks import spread
from evenstep.schema import FRAME_START, TS, VALUE, join_on, keys_of, require_panel, require_unique_stamps

#: Grid stamps written out per row of the block table.
GRID_BLOCK = 65_536


def grid_stamps(frame: DataFrame, step: str | timedelta, steps_per_block: int = GRID_BLOCK) -> DataFrame:
    """Every stamp from the first to the last of each slice, one step apart.

    A long span is first cut into blocks and those are spread over the tasks, so no task writes out a
    whole series.
    """
    step, keys = step_micros(step), keys_of(frame)
    last_step = F.call_function("div", stamp_micros("_last") - stamp_micros(FRAME_START), F.lit(step))
    span = (
        frame.groupBy(*keys)
        .agg(F.min(TS).alias(FRAME_START), F.max(TS).alias("_last"))
        .withColumn("_steps", last_step)
    )
    last_block = F.call_function("div", F.col("_steps"), F.lit(steps_per_block))
    blocks = span.select(*keys, FRAME_START, "_steps", F.explode(F.sequence(F.lit(0).cast("bigint"), last_block)).alias("_part"))
    first = F.col("_part") * steps_per_block
    numbered = F.sequence(first, F.least(first + (steps_per_block - 1), F.col("_steps")))
    return (
        spread(blocks, *keys, "_part")
        .select(*keys, FRAME_START, F.explode(numbered).alias("_step"))
        .select(*keys, shift_stamp(FRAME_START, F.col("_step") * step).alias(TS))
    )


def complete_grid(frame: DataFrame, step: str | timedelta = "h", check: bool = True) -> DataFrame:
    """The series on its complete grid, with null where nothing was shipped. Off-grid rows fall away."""
    require_panel(frame, FeatureError)
    if check:
        require_unique_stamps(frame, FeatureError)
    keys = keys_of(frame)
    return join_on(grid_stamps(frame, step), frame.select(*keys, TS, VALUE), [*keys, TS], "left")


def missing_stamps(frame: DataFrame, step: str | timedelta = "h") -> DataFrame:
    """Grid stamps that do not occur in the series."""
    require_panel(frame, FeatureError, target=TS)
    keys = keys_of(frame)
    return join_on(grid_stamps(frame, step), frame.select(*keys, TS), [*keys, TS], "left_anti")
