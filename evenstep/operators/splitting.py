"""Dividing each series in time order."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, functions as F

from evenstep.errors import SequenceError, SplitError
from evenstep.functions.stamps import step_micros
from evenstep.operators.blocks import TOTALS_BLOCK, stamps_at
from evenstep.schema import FRAME_START, SERIES, SPLIT, TARGET_TS, TS, join_on, keys_of, require_keys, require_panel
from evenstep.sources.storage import settle

SPLITS = ("train", "validation", "test")


def require_ratios(train: float, validation: float, test: float) -> None:
    ratios = (train, validation, test)
    if not all(0.0 < r < 1.0 for r in ratios):
        raise SplitError(f"each split ratio must lie between 0 and 1, got {ratios}")
    if abs(sum(ratios) - 1.0) > 1e-9:
        raise SplitError(f"split ratios must add up to 1, got {ratios} adding up to {sum(ratios):.6g}")


def _share(n: Column, ratio: float) -> Column:
    """Whole rows in a share, truncated in double arithmetic: 70% of 90 rows is 62, as 90 * 0.7 < 63."""
    return F.floor(n.cast("double") * F.lit(float(ratio))).cast("bigint")


def split_bounds(
    series: DataFrame,
    train: float = 0.7,
    validation: float = 0.15,
    test: float = 0.15,
    step: str | timedelta = "h",
    steps_per_block: int = TOTALS_BLOCK,
) -> DataFrame:
    """Per series: ``n`` and the first stamp of each split. All a splitter has to know about a series."""
    require_panel(series, SplitError, target=TS)
    require_ratios(train, validation, test)
    n = F.col("n")
    n_train, n_validation = _share(n, train), _share(n, validation)
    return stamps_at(
        series,
        {"train_start": F.lit(0), "validation_start": n_train, "test_start": n_train + n_validation},
        [SERIES],
        step=step_micros(step),
        steps_per_block=steps_per_block,
    )


def chronological_split(
    series: DataFrame,
    train: float = 0.7,
    validation: float = 0.15,
    test: float = 0.15,
    step: str | timedelta = "h",
    check: bool = True,
    steps_per_block: int = TOTALS_BLOCK,
) -> DataFrame:
    """Add ``split`` and ``frame_start``. Never shuffled; the test split takes what truncation leaves over.

    Membership is a comparison of the stamp with two cut stamps per series, so rows are not ordered and no
    row is moved for its rank. The cuts, one row per series, are stored first: whether they are broadcast
    then follows from their measured size. The series is read three times; pass a stored one. ``step`` only
    sizes the blocks that locate the cuts.
    """
    if check:
        require_keys(series, SplitError)
    bounds = settle(split_bounds(series, train, validation, test, step, steps_per_block))
    if check:
        n = F.col("n")
        empty = (F.least(_share(n, train), _share(n, validation), n - _share(n, train) - _share(n, validation)) < 1)
        refused = bounds.where(empty).select(SERIES, "n").limit(5).collect()
        if refused:
            names = ", ".join(f"{r[SERIES]} ({r['n']} rows)" for r in refused)
            raise SplitError(f"{train}/{validation}/{test} leaves a split empty for: {names}")
    label = (
        F.when(F.col(TS) < F.col("validation_start"), SPLITS[0])
        .when(F.col("test_start").isNull() | (F.col(TS) < F.col("test_start")), SPLITS[1])
        .otherwise(SPLITS[2])
    )
    start = F.col("train_start")
    for name in SPLITS[1:]:
        start = F.when(F.col(SPLIT) == name, F.col(f"{name}_start")).otherwise(start)
    return (
        join_on(series, bounds, [SERIES])
        .withColumn(SPLIT, label)
        .withColumn(FRAME_START, start)
        .drop("n", *[f"{name}_start" for name in SPLITS])
    )


def split_summary(divided: DataFrame) -> DataFrame:
    """Per series and split: rows, first and last stamp."""
    return divided.groupBy(SERIES, SPLIT).agg(
        F.count("*").alias("rows"), F.min(TS).alias("first_ts"), F.max(TS).alias("last_ts")
    )


def reassemble(*parts: DataFrame) -> DataFrame:
    """The splits of a panel as one series again: the union of the parts, without their split columns."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.drop(SPLIT, FRAME_START)


def tail_holdout(
    windows: DataFrame,
    fraction: float = 0.1,
    step: str | timedelta = "h",
    stamp: str = TARGET_TS,
    check: bool = True,
) -> DataFrame:
    """Add ``part``: ``holdout`` for the last share of each slice's windows in time order, else ``fit``."""
    if stamp not in windows.columns:
        raise SequenceError(f"no column {stamp!r}; the frame has {windows.columns}")
    keys = keys_of(windows)
    cut = _share(F.col("n"), 1.0 - fraction)
    bounds = settle(stamps_at(windows, {"_cut": cut}, keys, stamp=stamp, step=step_micros(step)))
    if check:
        refused = bounds.where((cut < 1) | (cut >= F.col("n"))).limit(1).collect()
        if refused:
            raise SequenceError(f"{refused[0]['n']} window(s) leave an empty side at fraction {fraction}")
    held = F.coalesce(F.col(stamp) >= F.col("_cut"), F.lit(False))
    return (
        join_on(windows, bounds, keys)
        .withColumn("part", F.when(held, "holdout").otherwise("fit"))
        .drop("n", "_cut")
    )
