"""Arithmetic on wall-clock stamps that does not depend on the session time zone."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, functions as F

# Microseconds per step unit. Month-like units have no fixed length and are refused.
UNIT_MICROS = {
    "us": 1,
    "ms": 1_000,
    "s": 1_000_000,
    "min": 60_000_000,
    "h": 3_600_000_000,
    "D": 86_400_000_000,
}


def step_micros(step: str | timedelta) -> int:
    """Length of one step in microseconds."""
    if isinstance(step, timedelta):
        micros = step // timedelta(microseconds=1)
        if micros <= 0:
            raise ValueError(f"step must be positive, got {step}")
        return micros
    if step not in UNIT_MICROS:
        raise ValueError(f"step {step!r} has no fixed length; use one of {sorted(UNIT_MICROS)} or a timedelta")
    return UNIT_MICROS[step]


def stamp_micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 read off the wall clock.

    Built from date and time parts: casting TIMESTAMP_NTZ to TIMESTAMP instead would pass through the
    session time zone and fold two hours into one at a clock change.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    second = (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return (
        F.unix_date(F.to_date(ts)).cast("bigint") * UNIT_MICROS["D"]
        + F.hour(ts).cast("bigint") * UNIT_MICROS["h"]
        + F.minute(ts).cast("bigint") * UNIT_MICROS["min"]
        + second
    )


def floor_to(number: Column, width: int) -> Column:
    """Index of the width-sized bin holding a whole number; right for negatives too."""
    return F.call_function("div", number - F.pmod(number, F.lit(width)), F.lit(width))


def shift_stamp(ts: Column | str, micros: Column | int) -> Column:
    """A wall-clock stamp moved by a number of microseconds."""
    micros = F.lit(micros) if isinstance(micros, int) else micros
    return F.timestamp_add("MICROSECOND", micros.cast("bigint"), ts)


def floor_stamp(ts: Column | str, step: str | timedelta) -> Column:
    """The start of the step-sized bin holding a stamp."""
    width = F.lit(step_micros(step))
    return shift_stamp(ts, -F.pmod(stamp_micros(ts), width))
