"""The given tables read as time series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evenstep.functions.stamps import floor_stamp
from evenstep.plans.preparation import Recipe
from evenstep.schema import SERIES, TS, VALUE
from evenstep.sources.observations import observations

#: Daily totals at the usual reach: long look-back, day-ahead-sized horizon.
LONG = Recipe(step="D")
#: Daily series with gaps.
SHORT = Recipe(step="D", lags=(1, 2, 3, 7, 14), rolling=(7, 14), sequence_length=14, horizon=7, season=14)
#: Hourly series with many gaps.
HOURLY = Recipe(step="h", lags=(1, 2, 3, 12), rolling=(6, 12), sequence_length=6, horizon=3, season=12)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity shipped per day, one series."""
    lines = observations(_table(spark, sf_dir, "lineitem"), "l_shipdate", "l_quantity", source="lineitem")
    return lines.groupBy(SERIES, TS).agg(F.sum(VALUE).alias(VALUE))


def daily_quantity_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity shipped per day, one series per return flag and line status."""
    key = F.concat("l_returnflag", "l_linestatus")
    lines = observations(_table(spark, sf_dir, "lineitem"), "l_shipdate", "l_quantity", key, source="lineitem")
    return lines.groupBy(SERIES, TS).agg(F.sum(VALUE).alias(VALUE))


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw event readings stamped with their hour, in hundredths, one series per event type.

    Hundredths are whole numbers, so their sums do not depend on the order of addition.
    """
    readings = observations(_table(spark, sf_dir, "events"), "ts", "value", "event_type", source="events")
    return readings.select(SERIES, floor_stamp(TS, "h").alias(TS), F.round(F.col(VALUE) * 100).alias(VALUE))


def shipments_in_order_of_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ship dates per supplier, with the order in which the lines were entered."""
    lines = _table(spark, sf_dir, "lineitem")
    return observations(
        lines, "l_shipdate", "l_quantity", "l_suppkey", ("l_orderkey", "l_linenumber"), source="lineitem"
    )


def order_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of versions kept as text, where the largest text is not the largest number."""
    orders = _table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderpriority").alias("name"), F.col("o_orderkey").cast("string").alias("version"))
