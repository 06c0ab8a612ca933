"""Calendar columns read off the stamp alone, so they cannot leak the target."""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from evenstep.errors import FeatureError
from evenstep.functions.stamps import floor_to, stamp_micros, step_micros
from evenstep.schema import FRAME_START, SERIES, TS, join_on, keys_of, require_panel
from evenstep.sources.storage import settle

# Fixed values: (column, values in one turn, first value).
CYCLES = (("hour", 24, 0), ("dayofweek", 7, 0), ("month", 12, 1))

CALENDAR_NAMES = (
    ["hour", "dayofweek", "month"]
    + [f"{name}_{part}" for name, _, _ in CYCLES for part in ("sin", "cos")]
    + ["is_weekend", "is_holiday"]
)

# US federal holidays, days written as month * 100 + day of month. Floating ones are (weekday with
# Monday=0, first and last day on which they can fall, first year); fixed ones are (day, first year).
FLOATING_HOLIDAYS = (
    (0, 115, 121, 1986),
    (0, 215, 221, None),
    (0, 525, 531, None),
    (0, 901, 907, None),
    (0, 1008, 1014, None),
    (3, 1122, 1128, None),
)
FIXED_HOLIDAYS = ((101, None), (619, 2021), (704, None), (1111, None), (1225, None))


def cyclic(value: Column, period: int, first: int = 0) -> tuple[Column, Column]:
    """Sine and cosine of a repeating ordinal, so its last value sits beside its first."""
    angle = F.lit(2 * math.pi) * ((value - F.lit(first)) / F.lit(period))
    return F.sin(angle), F.cos(angle)


def is_federal_holiday(day: Column) -> Column:
    """Whether a DATE is an observed US federal holiday.

    A fixed holiday on a Saturday is observed on the Friday before, one on a Sunday on the Monday after.
    """
    # A day in June falls in the year of its neighbours, so the year need not move with the day.
    year, weekday = F.year(day), F.weekday(day)

    def month_day(shift: int) -> Column:
        moved = F.date_add(day, shift) if shift else day
        return F.month(moved) * 100 + F.dayofmonth(moved)

    def since(first: int | None, match: Column) -> Column:
        return match & (year >= first) if first else match

    def fixed(shift: int) -> Column:
        there = month_day(shift)
        always = there.isin([on for on, first in FIXED_HOLIDAYS if first is None])
        return reduce(or_, [since(first, there == on) for on, first in FIXED_HOLIDAYS if first], always)

    today = month_day(0)
    floating = [
        since(first, (weekday == on) & today.between(low, high)) for on, low, high, first in FLOATING_HOLIDAYS
    ]
    observed = ((weekday < 5) & fixed(0)) | ((weekday == 4) & fixed(1)) | ((weekday == 0) & fixed(-1))
    return reduce(or_, floating) | observed


def with_frame_start(frame: DataFrame) -> DataFrame:
    """Add the first stamp of each slice, unless the frame already carries it.

    One row per slice is stored and joined back, so whether it is broadcast follows from its measured size.
    """
    if FRAME_START in frame.columns:
        return frame
    keys = keys_of(frame)
    starts = settle(frame.groupBy(*keys).agg(F.min(TS).alias(FRAME_START)))
    return join_on(frame, starts, keys, "left")


def calendar_columns(holidays: bool = True) -> list[tuple[str, Column]]:
    """Name and expression of each calendar column, in output order. Row-local, no shuffle."""
    ts = F.col(TS)
    ordinals = {"hour": F.hour(ts), "dayofweek": F.weekday(ts), "month": F.month(ts)}
    out = [(name, ordinals[name].cast("int")) for name, _, _ in CYCLES]
    for name, period, first in CYCLES:
        sine, cosine = cyclic(ordinals[name], period, first)
        out += [(f"{name}_sin", sine), (f"{name}_cos", cosine)]
    out.append(("is_weekend", (ordinals["dayofweek"] >= 5).cast("int")))
    if holidays:
        # A slice that begins after midnight does not flag its own first day: midnight lies before its start.
        midnight_inside = F.to_date(ts).cast("timestamp_ntz") >= F.col(FRAME_START)
        out.append(("is_holiday", (is_federal_holiday(F.to_date(ts)) & midnight_inside).cast("int")))
    return out


def add_calendar(frame: DataFrame, holidays: bool = True) -> DataFrame:
    return frame.withColumns(dict(calendar_columns(holidays)))


def calendar_features(frame: DataFrame, holidays: bool = True) -> DataFrame:
    """Eleven calendar columns per row (ten without holidays); every other column passes through."""
    require_panel(frame, FeatureError, target=TS)
    carried = FRAME_START in frame.columns
    out = add_calendar(with_frame_start(frame) if holidays else frame, holidays)
    return out if carried or not holidays else out.drop(FRAME_START)


def holiday_dates(frame: DataFrame) -> DataFrame:
    """``[series_id, holiday]``: every observed holiday within each series' span, for semi-joins by day."""
    require_panel(frame, FeatureError, target=TS)
    day = step_micros("D")
    span = frame.groupBy(SERIES).agg(F.min(TS).alias("_first"), F.max(TS).alias("_last"))
    first_day = floor_to(stamp_micros("_first"), day)
    last_day = floor_to(stamp_micros("_last"), day)
    days = span.select(SERIES, "_first", F.explode(F.sequence(first_day, last_day)).alias("_day")).select(
        SERIES, "_first", F.date_from_unix_date(F.col("_day").cast("int")).alias("holiday")
    )
    inside = F.col("holiday").cast("timestamp_ntz") >= F.col("_first")
    return days.where(is_federal_holiday(F.col("holiday")) & inside).select(SERIES, "holiday")
