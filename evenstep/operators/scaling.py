"""Standardisation with statistics of the training split."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType

from evenstep.errors import ScalerError
from evenstep.schema import SERIES, SPLIT, VALUE, feature_columns, join_on
from evenstep.sources.storage import settle


def scale_columns(frame: DataFrame, target: str = VALUE) -> list[str]:
    """Columns of ``frame`` that the target's statistics make sense for: the target, then whatever has its units."""
    history = re.compile(r"(lag|rolling_mean|rolling_std)_\d+h")
    return [target, *filter(history.fullmatch, frame.columns)]


class SeriesScaler:
    """Standardisation per series, held as a table: a row for each series and, in ``known``, a field for each column.

    The table says all there is to say: which columns are scaled follows from its schema, and it is joined to whatever is
    to be scaled. Nothing is collected; whether that join broadcasts follows from the stored table's size.
    """

    def __init__(self, columns: Sequence[str] | None = None, kind: str = "standard", known: DataFrame | None = None) -> None:
        if kind != "standard":
            raise ScalerError(f"no {kind!r} scaling; the kind is 'standard'")
        self.wanted, self.known = columns, known

    def fit(self, frame: DataFrame, check: bool = True) -> SeriesScaler:
        """Learn means and sample deviations from a frame, or from its training rows when it carries splits.

        With ``check``, columns that never change in some series are refused: there is nothing to divide by.
        """
        names = list(self.wanted) if self.wanted is not None else feature_columns(frame)
        _require(names, frame, "cannot fit")
        rows = frame.where(F.col(SPLIT) == "train") if SPLIT in frame.columns else frame
        learned = F.struct(*[F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std")).alias(c) for c in names])
        known = settle(rows.groupBy(SERIES).agg(learned.alias("known")))
        flat = SeriesScaler(known=known).constant_columns().limit(20).collect() if check else []
        if flat:
            raise ScalerError(f"column(s) {sorted({r['column'] for r in flat})} are constant, e.g. in series {flat[0][SERIES]}")
        self.known = known
        return self

    @property
    def columns(self) -> list[str]:
        """What is scaled, in the order of the table."""
        return self._table().schema["known"].dataType.names

    def stats(self) -> DataFrame:
        """``[series_id, column, mean, std]``, the form to store and to read."""
        cells = [F.struct(F.lit(c).alias("column"), _at("known", c, "mean"), _at("known", c, "std")) for c in self.columns]
        return self._table().select(SERIES, F.inline(F.array(*cells)))

    @classmethod
    def from_stats(cls, stats: DataFrame, columns: Sequence[str]) -> SeriesScaler:
        """The scaler that gave ``stats``."""
        one = [F.struct(*[F.max(F.when(F.col("column") == c, F.col(s))).alias(s) for s in ("mean", "std")]).alias(c) for c in columns]
        return cls(known=stats.groupBy(SERIES).agg(F.struct(*one).alias("known")))

    def constant_columns(self) -> DataFrame:
        """``[series_id, column]`` where the standard deviation is zero. One row alone has none, and passes."""
        return self.stats().where("std = 0").select(SERIES, "column")

    def transform(self, frame: DataFrame, arrays: Sequence[str] = (), column: str = VALUE) -> DataFrame:
        """``(x - mean) / std`` on the fitted columns; ``arrays`` holds values of ``column``, scaled alike.

        A series that was not in the training rows keeps its rows and gets nulls.
        """
        _require(self.columns, frame, "the frame to scale has no")
        of = dict.fromkeys(arrays, column) | {c: c for c in self.columns}
        return self._applied(frame, of, lambda x, mean, std: (x - mean) / std)

    def inverse_transform(self, frame: DataFrame, values: Sequence[str], column: str = VALUE) -> DataFrame:
        """Bring columns of scaled ``column`` values, plain or arrays, back to original units."""
        return self._applied(frame, dict.fromkeys(values, column), lambda x, mean, std: x * std + mean)

    def fit_transform(self, frame: DataFrame, check: bool = True) -> DataFrame:
        return self.fit(frame, check).transform(frame)

    def _applied(self, frame: DataFrame, of: dict[str, str], formula: Callable[[Column, Column, Column], Column]) -> DataFrame:
        """``formula`` on each named column, or on every element of an array, with the statistics of the column it is ``of``."""
        unknown = sorted(set(of.values()) - set(self.columns))
        if unknown:
            raise ScalerError(f"no statistics of {', '.join(map(repr, unknown))}; there are some of {self.columns}")
        joined = join_on(frame, self._table().withColumnRenamed("known", "_known"), [SERIES], "left")
        changed = {}
        for name, source in of.items():
            one = partial(formula, mean=_at("_known", source, "mean"), std=_at("_known", source, "std"))
            listed = isinstance(frame.schema[name].dataType, ArrayType)
            changed[name] = _each(name, one) if listed else one(F.col(name))
        return joined.withColumns(changed).select(*frame.columns)

    def _table(self) -> DataFrame:
        if self.known is None:
            raise ScalerError("nothing to scale by: fit() was never called")
        return self.known


def _require(names: Sequence[str], frame: DataFrame, complaint: str) -> None:
    absent = sorted(set(names) - set(frame.columns))
    if absent:
        raise ScalerError(f"{complaint}: column(s) {absent}")


def _each(array: str, function: Callable[[Column], Column]) -> Column:
    return F.transform(array, lambda x: function(x))


def _at(table: str, column: str, statistic: str) -> Column:
    return F.col(table).getField(column).getField(statistic).alias(statistic)


def split_drift(scaled: DataFrame, target: str = VALUE) -> DataFrame:
    """Per series and split: mean of the scaled target. Away from zero means the level has moved since training."""
    return scaled.groupBy(SERIES, SPLIT).agg(F.avg(target).alias("mean_scaled"))
