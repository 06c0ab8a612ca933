"""Column names of the panel, and the schema guards shared by every operator.

A panel is a DataFrame with one row per reading: ``series_id STRING``, ``ts TIMESTAMP_NTZ``,
``value DOUBLE``. After splitting it also carries ``split`` and ``frame_start``, the first stamp of
the row's (series, split), on which the time grid of that slice is anchored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import TimestampNTZType

SERIES, TS, VALUE = "series_id", "ts", "value"
SPLIT, FRAME_START = "split", "frame_start"
TARGET_TS, Y, YHAT = "target_ts", "y", "yhat"

_NOT_FEATURES = {SERIES, TS, SPLIT, FRAME_START, TARGET_TS, Y, YHAT}


def keys_of(frame: DataFrame) -> list[str]:
    """The columns that isolate one slice of time. A frame with a split never reads across it."""
    return [SERIES, SPLIT] if SPLIT in frame.columns else [SERIES]


def feature_columns(frame: DataFrame) -> list[str]:
    """Model inputs, in frame order. The target at the row's own stamp is one of them."""
    return [c for c in frame.columns if c not in _NOT_FEATURES]


def require_panel(frame: DataFrame, error: type[Exception], target: str = VALUE) -> None:
    """Schema-only guard, no job: the key, stamp and target columns exist and ``ts`` is a wall clock."""
    for column in (SERIES, TS, target):
        if column not in frame.columns:
            raise error(f"no column {column!r}; the frame has {frame.columns}")
    stamp = frame.schema[TS].dataType
    if not isinstance(stamp, TimestampNTZType):
        raise error(f"column {TS!r} is {stamp.simpleString()}, not timestamp_ntz; use observations() first")


def require_keys(frame: DataFrame, error: type[Exception]) -> None:
    """One small action, pushed down to the files: refuse rows without a series or a stamp.

    They belong to no slice, so a join or a block would lose them without a word.
    """
    if frame.where(F.col(SERIES).isNull() | F.col(TS).isNull()).select(F.lit(1)).limit(1).collect():
        raise error("a row lacks its series or its stamp; name every series, and run clean() first")


def require_unique_stamps(frame: DataFrame, error: type[Exception]) -> None:
    """Small actions: refuse rows without a key, and a frame in which a stamp occurs twice within a slice."""
    require_keys(frame, error)
    keys = keys_of(frame)
    repeated = frame.groupBy(*keys, TS).count().where(F.col("count") > 1).limit(1).collect()
    if repeated:
        row = repeated[0]
        where = ", ".join(str(row[k]) for k in keys)
        raise error(f"stamp {row[TS]} occurs {row['count']} times in ({where}); run clean() first")


def null_counts(frame: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``[column, null_rows]``: nulls per column, counted in one pass over the frame."""
    columns = columns if columns is not None else [c for c in frame.columns if c not in (SERIES, SPLIT, FRAME_START)]
    counted = frame.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("null_rows")) for c in columns])
    return counted.select(F.inline(pairs))


def require_no_nulls(frame: DataFrame, columns: list[str], error: type[Exception]) -> None:
    """One small action: refuse nulls, naming the columns that hold them."""
    bad = [r["column"] for r in null_counts(frame, columns).where("null_rows > 0").collect()]
    if bad:
        raise error(f"column(s) {bad} hold nulls; drop those rows first, the gap they leave is respected")


def long_form(frame: DataFrame, keep: list[str], array: str, value: str, step: str = "step") -> DataFrame:
    """One row per array element, steps counted from 1."""
    return frame.select(*keep, F.posexplode(array).alias("_pos", value)).select(
        *keep, (F.col("_pos") + 1).cast("int").alias(step), value
    )


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on slice keys, in which a null is a key like any other, so that rows without a series stay.

    ``left`` keeps its key columns; those of ``right`` go.
    """
    named = right.select(*[F.col(k).alias(f"_on_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    joined = left.join(named, all_of([F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys]), how)
    return joined.drop(*[f"_on_{k}" for k in keys])


def all_of(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for condition in conditions:
        out = out & condition
    return out
