"""Multi-step targets: the mirror of lags."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from evenstep.errors import TargetError
from evenstep.functions.calendar import with_frame_start
from evenstep.functions.stamps import shift_stamp, step_micros
from evenstep.operators.blocks import GRIDDED, home_rows, in_block, steps_between, to_blocks
from evenstep.schema import (
    FRAME_START,
    TARGET_TS,
    TS,
    VALUE,
    Y,
    feature_columns,
    require_no_nulls,
    require_panel,
    require_unique_stamps,
)


def add_targets(blocked: DataFrame, horizon: int, step: int, target: str = VALUE) -> DataFrame:
    """``y`` and ``target_ts`` on a frame in blocks. A row without a complete future keeps a shorter ``y``.

    Off-grid rows lend no values and have no future, so they fall away.
    """
    known = blocked.withColumn("_known", F.when(F.col(GRIDDED), F.col(target)))
    future = F.collect_list("_known").over(steps_between(in_block(blocked), 1, horizon, step))
    return known.withColumns({Y: future, TARGET_TS: shift_stamp(TS, step)}).where(F.col(GRIDDED)).drop("_known")


def horizon_targets(
    frame: DataFrame,
    horizon: int = 24,
    step: str | timedelta = "h",
    target: str = VALUE,
    check: bool = True,
    steps_per_block: int | None = None,
) -> DataFrame:
    """Pair each row with the values at the next ``horizon`` steps of the given frame, ``y ARRAY<DOUBLE>``.

    Rows whose future crosses a gap or the end of the slice are dropped: their future is unknown. With
    ``check``, nulls, repeated stamps and an empty answer are refused.
    """
    require_panel(frame, TargetError, target)
    if horizon < 1:
        raise TargetError(f"horizon must be positive, got {horizon}")
    if check:
        require_no_nulls(frame, [TS, *feature_columns(frame)], TargetError)
        require_unique_stamps(frame, TargetError)
    step = step_micros(step)
    carried = FRAME_START in frame.columns
    blocked = to_blocks(with_frame_start(frame), step, 0, horizon, steps_per_block)
    out = home_rows(add_targets(blocked, horizon, step, target)).where(F.size(Y) == horizon)
    if check and out.isEmpty():
        raise TargetError(f"no unbroken run has {horizon} steps after a row")
    return out if carried else out.drop(FRAME_START)
