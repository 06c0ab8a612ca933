"""What a series read some stretch of time ago, and the mean and spread over a stretch before each row."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from math import isqrt

from pyspark.sql import DataFrame, Window, WindowSpec, functions as F

from evenstep.errors import FeatureError
from evenstep.functions.calendar import with_frame_start
from evenstep.functions.stamps import step_micros
from evenstep.operators.blocks import (
    BLOCK,
    GRIDDED,
    MOST_ROWS,
    TOTALS_BLOCK,
    directory,
    home_rows,
    in_block,
    rows_before,
    spread,
    steps_between,
    to_blocks,
)
from evenstep.schema import FRAME_START, TS, VALUE, all_of, join_on, keys_of, require_panel, require_unique_stamps
from evenstep.sources.storage import settle


#: Longest trailing window that is recomputed for every row; longer ones are put together from parts.
DIRECT_WINDOW = 32
# The lags and trailing windows of an hourly load series.
LAGS, ROLLING = (1, 2, 3, 24, 48, 168), (24, 168)


def require_periods(lags: Sequence[int], rolling: Sequence[int]) -> None:
    if any(lag < 1 for lag in lags):
        raise FeatureError(f"a lag reaches at least one step back, got {list(lags)}")
    if any(window < 2 for window in rolling):
        raise FeatureError(f"a rolling window spans at least two steps, got {list(rolling)}")


def lag_names(lags: Sequence[int], rolling: Sequence[int]) -> list[str]:
    """Column names, in output order. The ``h`` is part of the name whatever the step."""
    stats = [f"rolling_{stat}_{window}h" for window in rolling for stat in ("mean", "std")]
    return [f"lag_{lag}h" for lag in lags] + stats


def with_history(frame: DataFrame, lags: Sequence[int], rolling: Sequence[int], target: str = VALUE) -> DataFrame:
    """Rows whose target, lags and trailing statistics are all known.

    A trailing deviation is known exactly when its mean is, so the filter does not name it: pushed below the
    projection, the filter would work out its long expression a second time.
    """
    needed = [target, *[n for n in lag_names(lags, rolling) if not n.startswith("rolling_std_")]]
    return frame.where(all_of([F.col(name).isNotNull() for name in needed]))


def add_lags(
    blocked: DataFrame, lags: Sequence[int], rolling: Sequence[int], step: int, target: str = VALUE
) -> DataFrame:
    """Lag and rolling columns on a frame in blocks; all share one window spec, so one sort.

    Off-grid rows neither get features nor lend their value to others.
    """
    spec = in_block(blocked)
    gridded = F.col(GRIDDED)
    known = blocked.withColumn("_known", F.when(gridded, F.col(target)))
    columns = {
        f"lag_{lag}h": F.when(gridded, F.max("_known").over(steps_between(spec, -lag, -lag, step))) for lag in lags
    }
    out, held = _trailing(known.withColumns(columns), rolling, spec, step)
    for window in rolling:
        mean, squares = held[window]
        out = out.withColumns(
            {
                f"rolling_mean_{window}h": F.when(gridded, F.col(mean)),
                f"rolling_std_{window}h": F.when(gridded, F.sqrt(F.col(squares) / (window - 1))),
            }
        )
    kept = [*blocked.columns, *lag_names(lags, rolling)]
    return out.select(*dict.fromkeys(kept))


def _trailing(
    frame: DataFrame, windows: Sequence[int], spec: WindowSpec, step: int
) -> tuple[DataFrame, dict[int, tuple[str, str]]]:
    """Mean and sum of squared deviations of ``_known`` over the steps before a row, null unless complete.

    A sliding frame is recomputed for every row, at a cost that grows with its length. A long window is
    therefore put together from adjoining shorter ones, each read off the row it ends at: means add up by
    weight, and squared deviations are those inside the parts plus those of the part means. Nothing is
    subtracted, so no precision is lost, and a missing part makes the whole null.
    """
    held: dict[int, tuple[str, str]] = {}

    def add(length: int) -> None:
        nonlocal frame
        if length in held:
            return
        names = (f"_mean_{length}", f"_squares_{length}")
        if length <= DIRECT_WINDOW:
            over = steps_between(spec, -length, -1, step)
            full = F.count("_known").over(over) == length
            spread = F.var_pop("_known").over(over) * length
            frame = frame.withColumns(
                {names[0]: F.when(full, F.avg("_known").over(over)), names[1]: F.when(full, spread)}
            )
        else:
            part = _part_length(length)
            sizes = [part] * (length // part) + ([length % part] if length % part else [])
            for size in sizes:
                add(size)
            looked_up, pieces, behind = {}, [], 0
            for size in sizes:
                found = []
                for name in held[size]:
                    at = f"{name}_before_{behind}"
                    exactly = steps_between(spec, -behind, -behind, step)
                    looked_up[at] = F.max(name).over(exactly) if behind else F.col(name)
                    found.append(at)
                pieces.append((size, *found))
                behind += size
            mean = " + ".join(f"{size}D * {m}" for size, m, _ in pieces)
            frame = frame.withColumns(looked_up).withColumn(names[0], F.expr(f"({mean}) / {length}D"))
            inside = " + ".join(s for _, _, s in pieces)
            between = " + ".join(f"{size}D * ({m} - {names[0]}) * ({m} - {names[0]})" for size, m, _ in pieces)
            frame = frame.withColumn(names[1], F.expr(f"{inside} + {between}")).drop(*looked_up)
        held[length] = names

    for length in sorted(set(windows)):
        add(length)
    return frame, held


def _part_length(length: int) -> int:
    """Length of the parts of a long window, from its own length alone, so that no other window changes its digits.

    The longest direct window that fits evenly, or about the root.
    """
    even = [w for w in range(2, DIRECT_WINDOW + 1) if length % w == 0 and length // w <= DIRECT_WINDOW]
    if even:
        return max(even)
    return isqrt(length) if length <= DIRECT_WINDOW**2 else length // DIRECT_WINDOW


def lag_features(
    frame: DataFrame,
    lags: Sequence[int] = LAGS,
    rolling: Sequence[int] = ROLLING,
    step: str | timedelta = "h",
    target: str = VALUE,
    check: bool = True,
    steps_per_block: int | None = None,
) -> DataFrame:
    """``lag_{n}h``: the value exactly n steps before; ``rolling_mean/std_{w}h``: over the w steps before.

    Null where that history is incomplete: a stamp missing from the series, a null in it, or a time
    before the row's slice begins. The row's own value is in none of them.
    """
    require_panel(frame, FeatureError, target)
    require_periods(lags, rolling)
    if check:
        require_unique_stamps(frame, FeatureError)
    step = step_micros(step)
    carried = FRAME_START in frame.columns
    blocked = to_blocks(with_frame_start(frame), step, max([*lags, *rolling], default=0), 0, steps_per_block)
    out = home_rows(add_lags(blocked, lags, rolling, step, target))
    return out if carried else out.drop(FRAME_START)


def lag_disagreement(
    frame: DataFrame,
    lag: int = 24,
    step: str | timedelta = "h",
    target: str = VALUE,
    rows_per_chunk: int = 4_096,
) -> DataFrame:
    """Per slice: rows whose value ``lag`` rows before is not the value ``lag`` steps before, both known.

    ``lag`` rows back can be any time back, so a halo of time does not bound it. Rows are instead numbered
    within each slice from per-block counts, and the number serves as the position to look up.
    """
    require_panel(frame, FeatureError, target)
    micros, keys = step_micros(step), keys_of(frame)
    timed = settle(lag_features(frame, [lag], [], step, target, check=False))  # counted, then numbered
    numbered = number_rows(timed.withColumnRenamed(f"lag_{lag}h", "_timed"), micros)
    # Positions are gap-free, so a chunk of positions plus a halo of `lag` positions is always enough.
    first = F.call_function("div", F.col("_row"), F.lit(rows_per_chunk))
    last = F.call_function("div", F.col("_row") + lag, F.lit(rows_per_chunk))
    chunked = numbered.withColumn("_chunk", F.explode(F.sequence(first, last)))
    by_row = Window.partitionBy(*keys, "_chunk").orderBy("_row")
    compared = chunked.withColumn("_positional", F.lag(target, lag).over(by_row)).where(F.col("_chunk") == first)
    differ = F.col("_positional").isNotNull() & F.col("_timed").isNotNull() & (F.col("_positional") != F.col("_timed"))
    return compared.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if(differ).alias("disagreeing_rows"))


def number_rows(
    frame: DataFrame, step: int, steps_per_block: int = TOTALS_BLOCK, most_rows: int = MOST_ROWS
) -> DataFrame:
    """Add ``_row``, the exact zero-based position in time within the slice, without a sort per slice."""
    keys = keys_of(frame)
    blocks = directory(frame, keys, step, TS, steps_per_block, most_rows)
    offsets = rows_before(blocks.counts, keys).select(*keys, BLOCK, "_before")
    inside = F.row_number().over(Window.partitionBy(*keys, BLOCK).orderBy(TS)) - 1
    placed = spread(blocks.place(frame), *keys, BLOCK).withColumn("_inside", inside)
    return join_on(placed, offsets, [*keys, BLOCK]).withColumn("_row", F.col("_before") + F.col("_inside")).drop("_before", "_inside", BLOCK)


def feature_audit(features: DataFrame) -> DataFrame:
    """Per slice: rows, rows on holidays, and rows with incomplete history."""
    history = [c for c in features.columns if c.startswith(("lag_", "rolling_"))]
    incomplete = F.lit(False)
    for column in history:
        incomplete = incomplete | F.col(column).isNull()
    holiday = F.col("is_holiday") == 1 if "is_holiday" in features.columns else F.lit(False)
    return features.groupBy(*keys_of(features)).agg(
        F.count("*").alias("rows"),
        F.count_if(holiday).alias("holiday_rows"),
        F.count_if(incomplete).alias("incomplete_rows"),
    )
