"""Data-quality report per series."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from evenstep.errors import DataValidationError
from evenstep.functions.stamps import stamp_micros, step_micros
from evenstep.schema import SERIES, TS, VALUE, join_on, require_panel
from evenstep.sources.storage import settle

_SHOWN = 20


def _percent(ratio: Column | float) -> Column:
    ratio = F.lit(ratio) if isinstance(ratio, float) else ratio
    return F.format_string("%.4f%%", ratio * 100.0)


def validation_report(
    series: DataFrame,
    min_rows: int = 1000,
    allow_missing_target: float = 0.01,
    allow_missing_index: float = 0.01,
    step: str | timedelta = "h",
    target: str = VALUE,
    arrival: list[str] | None = None,
) -> DataFrame:
    """``[series_id, rows, missing_target_ratio, missing_index_ratio, problems]``, every rule in one pass.

    With ``arrival``, the columns that tell the order of arrival, late rows are a problem too.

    Hours absent from the grid are counted in closed form, as grid length less the stamps on the grid, so
    no grid is written out. Stamps are on the grid when they share their remainder modulo the step with
    the first stamp; counting per remainder first lets one aggregation serve both.
    """
    for name, ratio in (("allow_missing_target", allow_missing_target), ("allow_missing_index", allow_missing_index)):
        if not 0.0 <= ratio <= 1.0:
            raise DataValidationError(f"{name} must lie in [0, 1], got {ratio}")
    require_panel(series, DataValidationError, target)
    step = step_micros(step)

    missing = F.col(target).isNull() | F.isnan(F.col(target).cast("double"))
    per_stamp = (
        series.where(F.col(TS).isNotNull())
        .groupBy(SERIES, TS)
        .agg(F.count("*").alias("_rows"), F.count_if(missing).alias("_missing"))
    )
    micros = stamp_micros(TS)
    per_phase = per_stamp.groupBy(SERIES, F.pmod(micros, F.lit(step)).alias("_phase")).agg(
        F.sum("_rows").alias("_rows"),
        F.sum("_missing").alias("_missing"),
        F.count("*").alias("_stamps"),
        F.min(micros).alias("_first"),
        F.max(micros).alias("_last"),
    )
    per_series = per_phase.groupBy(SERIES).agg(
        F.sum("_rows").alias("rows"),
        F.sum("_missing").alias("_missing"),
        F.sum("_stamps").alias("_stamps"),
        F.min_by("_stamps", "_first").alias("_on_grid"),
        F.min("_first").alias("_first"),
        F.max("_last").alias("_last"),
    )
    counted = per_series.withColumns(
        {
            "_repeats": F.col("rows") - F.col("_stamps"),
            "_grid": F.call_function("div", F.col("_last") - F.col("_first"), F.lit(step)) + 1,
        }
    ).withColumns(
        {
            "missing_target_ratio": F.col("_missing") / F.col("rows"),
            # The closed form takes each stamp for one grid step.
            "_gaps": F.when((F.col("rows") > 1) & (F.col("_repeats") == 0), F.col("_grid") - F.col("_on_grid")).otherwise(0),
        }
    ).withColumn("missing_index_ratio", F.col("_gaps") / F.col("_grid"))
    rules = F.array(
        F.when(F.col("rows") < min_rows, F.concat(F.lit(f"fewer than {min_rows} rows: "), F.col("rows"))),
        F.when(
            F.col("missing_target_ratio") > allow_missing_target,
            F.concat(
                F.lit("missing target share "), _percent(F.col("missing_target_ratio")),
                F.lit(" is above "), _percent(float(allow_missing_target)),
            ),
        ),
        F.when(F.col("_repeats") > 0, F.concat(F.lit("repeated stamps: "), F.col("_repeats"))),
        F.when(
            F.col("missing_index_ratio") > allow_missing_index,
            F.concat(
                F.col("_gaps"), F.lit(" stamps absent from the grid, share "), _percent(F.col("missing_index_ratio")),
                F.lit(" is above "), _percent(float(allow_missing_index)),
            ),
        ),
    )
    if arrival:
        counted = join_on(counted, arrival_disorder(series, arrival).select(SERIES, "late_rows"), [SERIES], "left")
        late = F.when(F.col("late_rows") > 0, F.concat(F.col("late_rows"), F.lit(" rows arrived after a later stamp")))
        rules = F.concat(rules, F.array(late))
    return counted.select(
        SERIES, "rows", "missing_target_ratio", "missing_index_ratio",
        F.filter(rules, lambda rule: rule.isNotNull()).alias("problems"),
    )


def validate(series: DataFrame, **limits) -> DataFrame:
    """The report, after refusing series with problems; takes the arguments of ``validation_report``.

    Only a count and the first few faulty series come to the driver, however many there are. A frame without a
    stamped row has no series to report on and is refused as too short.
    """
    report = settle(validation_report(series, **limits))
    if report.isEmpty():
        raise DataValidationError(f"fewer than {limits.get('min_rows', 1000)} rows: 0")
    faulty = report.where(F.size("problems") > 0)
    shown = faulty.orderBy(SERIES).limit(_SHOWN).collect()
    if shown:
        total = len(shown) if len(shown) < _SHOWN else faulty.count()
        lines = [f"{row[SERIES]}: {'; '.join(row['problems'])}" for row in shown]
        rest = f" (and {total - len(shown)} more series)" if total > len(shown) else ""
        raise DataValidationError(" | ".join(lines) + rest)
    return report


def arrival_parts(raw: DataFrame, order: list[str], rows_per_chunk: int = 65_536) -> DataFrame:
    """Numbered rows cut into parts of about equal size along (series, arrival, stamp), each with its number ``_part``.

    The cuts are points of the whole order, not of the first number alone, so rows that share one number are spread
    as well. Stored, so that a part stays what it is however often it is read.
    """
    parts = max(1, -(-raw.select(order[0]).count() // rows_per_chunk))
    ranged = raw.repartitionByRange(parts, SERIES, *order, TS)
    return settle(ranged.withColumn("_part", F.spark_partition_id()))


def late_arrivals(raw: DataFrame, order: list[str], rows_per_chunk: int = 65_536) -> DataFrame:
    """Every row with ``late``: whether its stamp lies before one that arrived earlier in its series.

    ``order`` names the arrival order, its first column being a whole number; rows that tie in it arrived
    together and are not late against each other. A row without that number has no place in the order: its
    ``late`` is null and it makes no other row late. The running maximum is taken inside parts of about ``rows_per_chunk``
    rows (``arrival_parts``) and over the maxima of the parts, so no series is ordered in one task, even when
    all its rows arrived at one number.
    """
    require_panel(raw, DataValidationError, target=order[0])
    numbered = F.col(order[0]).cast("bigint").isNotNull()
    parts = arrival_parts(raw.where(numbered), order, rows_per_chunk)
    tops = parts.groupBy(SERIES, "_part").agg(F.max(TS).alias("_top"))
    earlier_parts = Window.partitionBy(SERIES).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier_rows = Window.partitionBy(SERIES, "_part").orderBy(*order, TS).rowsBetween(Window.unboundedPreceding, -1)
    before = tops.select(SERIES, "_part", F.max("_top").over(earlier_parts).alias("_before"))
    seen = F.greatest(F.col("_before"), F.max(TS).over(earlier_rows))
    judged = join_on(parts, before, [SERIES, "_part"]).withColumn("late", F.coalesce(F.col(TS) < seen, F.lit(False)))
    unnumbered = raw.where(~numbered).withColumn("late", F.lit(None).cast("boolean"))
    return judged.drop("_part", "_before").unionByName(unnumbered)


def arrival_disorder(raw: DataFrame, order: list[str], rows_per_chunk: int = 65_536) -> DataFrame:
    """Per series: rows, rows that arrived after a later stamp, and rows without an arrival number.

    Zero late rows means sorted ascending.
    """
    return late_arrivals(raw, order, rows_per_chunk).groupBy(SERIES).agg(
        F.count("*").alias("rows"), F.count_if("late").alias("late_rows"), F.count_if(F.col("late").isNull()).alias("unnumbered_rows")
    )
