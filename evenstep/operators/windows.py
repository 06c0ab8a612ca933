"""Gap segments and sliding windows for sequence models."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from evenstep.errors import SequenceError
from evenstep.functions.stamps import shift_stamp, stamp_micros, step_micros
from evenstep.operators.blocks import BLOCK, HOME, MICROS, MOST_ROWS, PHASE, TOTALS_BLOCK, directory, spread, to_blocks
from evenstep.schema import (
    TARGET_TS,
    TS,
    VALUE,
    feature_columns,
    join_on,
    keys_of,
    require_no_nulls,
    require_panel,
    require_unique_stamps,
)
from evenstep.sources.storage import settle


def gap_segments(
    frame: DataFrame,
    step: str | timedelta = "h",
    steps_per_block: int = TOTALS_BLOCK,
    most_rows: int = MOST_ROWS,
) -> DataFrame:
    """Add ``segment``: 1 for the first unbroken run of each slice, one more after every break.

    Rows are compared with the row before them inside blocks of at most ``most_rows`` rows. A block's first row is
    compared with the last stamp of the blocks before, and each row adds the breaks so far in its block to those of earlier blocks, so
    no slice is walked through in one task. The frame is read twice; pass a stored one.
    """
    require_panel(frame, SequenceError, target=TS)
    step, keys = step_micros(step), keys_of(frame)
    in_order = Window.partitionBy(*keys, BLOCK).orderBy(MICROS)
    so_far = F.sum(F.when(F.col("_gap") != step, 1).otherwise(0)).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    # Stored, since the totals of the blocks are needed before the first row is answered.
    marked = settle(_neighbours(frame, step, steps_per_block, most_rows).withColumn("_so_far", so_far))
    breaks = F.count_if(F.coalesce(F.col("_gap") != step, F.lit(True)))
    # The first row's gap reaches back into earlier blocks; it is a break of this block.
    per_block = marked.groupBy(*keys, BLOCK).agg(breaks.alias("_breaks"), F.max("_opens").alias("_opens"))
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_breaks").over(earlier), F.lit(0)) + F.col("_opens")
    offsets = per_block.select(*keys, BLOCK, before.alias("_before"))
    return (
        join_on(marked, offsets, [*keys, BLOCK])
        .withColumn("segment", (F.col("_before") + F.col("_so_far")).cast("bigint"))
        .drop("_before", "_so_far", "_gap", "_opens", MICROS, BLOCK)
    )


def _neighbours(frame: DataFrame, step: int, steps_per_block: int, most_rows: int) -> DataFrame:
    """Add ``_micros``, ``_block``, ``_gap`` (microseconds to the row before, null for a slice's first) and ``_opens``.

    ``_opens`` is 1 where the row is the first of its slice, else 0: the one break that no gap tells of.
    """
    keys = keys_of(frame)
    blocks = directory(frame, keys, step, TS, steps_per_block, most_rows)
    placed = blocks.place(frame).withColumn(MICROS, stamp_micros(TS))
    ends = placed.groupBy(*keys, BLOCK).agg(F.max(MICROS).alias("_end"))
    in_order = Window.partitionBy(*keys).orderBy(BLOCK)
    last = ends.select(*keys, BLOCK, F.lag("_end").over(in_order).alias("_last"))
    spec = Window.partitionBy(*keys, BLOCK).orderBy(MICROS)
    joined = join_on(spread(placed, *keys, BLOCK), last, [*keys, BLOCK])
    behind = F.coalesce(F.lag(MICROS).over(spec), F.col("_last"))
    gaps = joined.withColumn("_gap", F.col(MICROS) - behind).drop("_last")
    return gaps.withColumn("_opens", F.col("_gap").isNull().cast("int"))


def segment_lengths(segments: DataFrame, sequence_length: int, horizon: int) -> DataFrame:
    """Per segment: rows, first and last stamp, windows it yields, and whether it is too short for any."""
    needed = sequence_length + horizon
    rows = F.col("rows")
    return (
        segments.groupBy(*keys_of(segments), "segment")
        .agg(F.count("*").alias("rows"), F.min(TS).alias("first_ts"), F.max(TS).alias("last_ts"))
        .withColumn("windows", F.greatest(rows - (needed - 1), F.lit(0).cast("bigint")))
        .withColumn("too_short", rows < needed)
    )


def _run_ends(frame: DataFrame, step: int, steps_per_block: int | None, most_rows: int) -> DataFrame:
    """Add ``_micros`` and ``_run_end``, the last microsecond of the unbroken run that holds the row.

    Inside a block a run ends before the next break, found walking backwards; a run that goes on beyond its block ends
    before the first break of the blocks after, or with the slice. No row looks ahead farther than its block.
    """
    keys = keys_of(frame)
    stop = F.when(F.col("_gap") != step, F.col(MICROS) - F.col("_gap"))
    backwards = Window.partitionBy(*keys, BLOCK).orderBy(F.desc(MICROS)).rowsBetween(Window.unboundedPreceding, -1)
    near = _neighbours(frame, step, steps_per_block or TOTALS_BLOCK, most_rows)
    marked = settle(near.withColumns({"_stop": F.min(stop).over(backwards), "_stops": stop}).drop("_gap", "_opens"))
    per_block = marked.groupBy(*keys, BLOCK).agg(F.min("_stops").alias("_stops"), F.max(MICROS).alias("_end"))
    later = Window.partitionBy(*keys).orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
    beyond = F.coalesce(F.min("_stops").over(later), F.max("_end").over(Window.partitionBy(*keys)))
    joined = join_on(marked.drop("_stops"), per_block.select(*keys, BLOCK, beyond.alias("_beyond")), [*keys, BLOCK])
    return joined.withColumn("_run_end", F.coalesce("_stop", "_beyond")).drop("_stop", "_beyond", BLOCK)


def _whole(length: int, step: int) -> Column:
    """Whether the row and the ``length - 1`` rows after it are one unbroken run."""
    return F.col("_run_end") - F.col(MICROS) >= (length - 1) * step


def _require_windows(frame: DataFrame, sequence_length: int, horizon: int, target: str, check: bool) -> None:
    require_panel(frame, SequenceError, target)
    if sequence_length < 1 or horizon < 1:
        raise SequenceError(f"sequence_length and horizon must be positive, got {sequence_length}, {horizon}")
    if check:
        require_no_nulls(frame, [TS, *feature_columns(frame)], SequenceError)
        require_unique_stamps(frame, SequenceError)


def _refuse_empty(windows: DataFrame, sequence_length: int, horizon: int) -> None:
    if windows.isEmpty():
        raise SequenceError(f"every unbroken run is shorter than {sequence_length} + {horizon} steps")


def window_manifest(
    frame: DataFrame,
    sequence_length: int = 168,
    horizon: int = 24,
    step: str | timedelta = "h",
    check: bool = True,
    steps_per_block: int | None = None,
) -> DataFrame:
    """One row per window: ``start_ts``, ``target_ts`` (first predicted stamp) and ``end_ts``.

    Stamps only, each read once: a window begins where the run that holds a row goes on for long enough. This is the
    form to count, filter and split windows in.
    """
    _require_windows(frame, sequence_length, horizon, TS, check)
    step, keys, length = step_micros(step), keys_of(frame), sequence_length + horizon
    stamps = settle(frame.select(*keys, TS))
    out = _run_ends(stamps, step, steps_per_block, MOST_ROWS).where(_whole(length, step)).select(
        *keys,
        F.col(TS).alias("start_ts"),
        shift_stamp(TS, sequence_length * step).alias(TARGET_TS),
        shift_stamp(TS, (length - 1) * step).alias("end_ts"),
    )
    if check:
        _refuse_empty(out, sequence_length, horizon)
    return out


def window_store(
    frame: DataFrame,
    sequence_length: int = 168,
    horizon: int = 24,
    step: str | timedelta = "h",
    target: str = VALUE,
    features: Sequence[str] | None = None,
    dtype: str = "float",
    check: bool = True,
    steps_per_block: int | None = None,
) -> DataFrame:
    """The windows of a frame in about the size of the frame: a row per block of rows, to be written and kept.

    ``stamps``, ``x ARRAY<ARRAY<FLOAT>>`` (rows by features) and ``y ARRAY<FLOAT>`` (the target) hold a block's rows once,
    in time order; ``windows ARRAY<INT>`` the places where its windows begin. A window lies in one block: blocks are
    so much longer than a window that at most about one row in sixteen is held twice. Rows in no window are left out.
    ``expand_windows`` turns blocks into windows where they are read.
    """
    _require_windows(frame, sequence_length, horizon, target, check)
    step, keys, length = step_micros(step), keys_of(frame), sequence_length + horizon
    names = list(features) if features is not None else feature_columns(frame)
    needed = list(dict.fromkeys([*names, target]))
    rows = _run_ends(settle(frame.select(*keys, TS, *needed)), step, steps_per_block, MOST_ROWS)
    blocked = to_blocks(rows.drop(MICROS), step, 0, length - 1, steps_per_block)
    row = F.struct(
        MICROS,
        TS,
        F.array(*[F.col(name).cast(dtype) for name in names]).alias("x"),
        F.col(target).cast(dtype).alias("y"),
        (F.col(HOME) & _whole(length, step)).alias("begins"),
    )
    held = blocked.groupBy(*keys, BLOCK, PHASE).agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    begins = F.transform("_rows", lambda r, at: F.when(r["begins"], at))
    store = held.withColumn("windows", F.filter(begins, lambda at: at.isNotNull())).where(F.size("windows") > 0)
    # What lies before a block's first window or behind its last one is in none of its windows.
    first = F.array_min("windows")
    store = store.withColumn("_rows", F.slice("_rows", first + 1, F.array_max("windows") - first + length))
    out = store.select(
        *keys,
        F.col("_rows.ts").alias("stamps"),
        F.col("_rows.x").alias("x"),
        F.col("_rows.y").alias("y"),
        F.transform("windows", lambda at: at - first).alias("windows"),
    )
    if check:
        out = settle(out)
        _refuse_empty(out, sequence_length, horizon)
    return out


def expand_windows(store: DataFrame, sequence_length: int = 168, horizon: int = 24, step: str | timedelta = "h") -> DataFrame:
    """Windows with values of a ``window_store`` made for the same lengths; see ``sequence_windows``."""
    step, keys = step_micros(step), keys_of(store)
    placed = store.select(*keys, "stamps", "x", "y", F.explode("windows").alias("_at"))
    start = F.get("stamps", F.col("_at"))
    return placed.select(
        *keys,
        start.alias("start_ts"),
        shift_stamp(start, sequence_length * step).alias(TARGET_TS),
        F.slice("x", F.col("_at") + 1, sequence_length).alias("x"),
        F.slice("y", F.col("_at") + (sequence_length + 1), horizon).alias("y"),
    )


def sequence_windows(
    frame: DataFrame,
    sequence_length: int = 168,
    horizon: int = 24,
    step: str | timedelta = "h",
    target: str = VALUE,
    features: Sequence[str] | None = None,
    dtype: str = "float",
    check: bool = True,
    steps_per_block: int | None = None,
) -> DataFrame:
    """Windows with values: ``x ARRAY<ARRAY<FLOAT>>`` (steps by features) and ``y ARRAY<FLOAT>``.

    ``x`` holds every feature column, the target among them, over the first ``sequence_length`` rows; ``y``
    the target over the ``horizon`` rows after. About ``sequence_length`` times the size of its input: to keep
    windows, keep their ``window_store``.
    """
    store = window_store(frame, sequence_length, horizon, step, target, features, dtype, check, steps_per_block)
    return expand_windows(store, sequence_length, horizon, step)


def dataset_sizes(
    frame: DataFrame,
    targets: DataFrame,
    windows: DataFrame,
) -> DataFrame:
    """Per slice: feature rows, rows with a complete future, windows, and the number of features."""
    keys = keys_of(frame)
    parts = [
        frame.select(*keys, F.lit("rows").alias("_what")),
        targets.select(*keys, F.lit("target_rows").alias("_what")),
        windows.select(*keys, F.lit("windows").alias("_what")),
    ]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return union.groupBy(*keys).agg(
        *[F.count_if(F.col("_what") == what).alias(what) for what in ("rows", "target_rows", "windows")],
        F.lit(len(feature_columns(frame))).cast("int").alias("n_features"),
    )
