"""From raw readings to one row per stamp."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from evenstep.errors import DataSourceError
from evenstep.schema import SERIES, TS, VALUE, require_panel


def clean(raw: DataFrame) -> DataFrame:
    """``[series_id, ts, value]`` with one row per (series, stamp).

    Readings that share a stamp are averaged, since a repeated hour at a clock change is two real
    measurements. Missing readings are left out of the average; a stamp with none keeps a null. Gaps are
    kept, never filled. Readings without a stamp are dropped (``clean_audit`` counts them). Averages are
    partial before the shuffle, so a stamp that holds a large share of all rows costs one row per task.
    """
    require_panel(raw, DataSourceError)
    reading = F.when(~F.isnan(VALUE), F.col(VALUE).cast("double"))
    return raw.where(F.col(TS).isNotNull()).groupBy(SERIES, TS).agg(F.avg(reading).alias(VALUE))


def clean_audit(raw: DataFrame) -> DataFrame:
    """Per series: rows in, rows out, repeated stamps averaged away, and readings without a stamp."""
    require_panel(raw, DataSourceError)
    per_stamp = raw.groupBy(SERIES, TS).agg(F.count("*").alias("readings"))
    known = F.col(TS).isNotNull()
    return per_stamp.groupBy(SERIES).agg(
        F.sum("readings").alias("rows_in"),
        F.count_if(known).alias("rows_out"),
        F.coalesce(F.sum(F.when(known, F.col("readings") - 1)), F.lit(0)).alias("duplicates_averaged"),
        F.coalesce(F.sum(F.when(~known, F.col("readings"))), F.lit(0)).alias("null_stamps"),
    )


def duplicate_stamps(raw: DataFrame) -> DataFrame:
    """Per series: occurrences of a stamp after its first."""
    return clean_audit(raw).select(SERIES, F.col("duplicates_averaged").alias("duplicates"))
