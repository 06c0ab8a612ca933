"""The chain from a clean series to features, targets, windows, forecasts and scores."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Observation, functions as F

from evenstep.functions.calendar import CALENDAR_NAMES, add_calendar, with_frame_start
from evenstep.functions.stamps import step_micros
from evenstep.models.linear import LinearForecaster, fit_linear
from evenstep.models.naive import require_season, seasonal_naive
from evenstep.models.trees import PRESETS, TreeForecaster, fit_trees
from evenstep.operators.blocks import BLOCK, PHASE, home_rows, to_blocks
from evenstep.operators.evaluation import improvement_over, scores
from evenstep.operators.lags import add_lags, lag_names, require_periods, with_history
from evenstep.operators.scaling import SeriesScaler, scale_columns
from evenstep.operators.splitting import SPLITS, chronological_split, require_ratios
from evenstep.operators.targets import add_targets
from evenstep.operators.windows import expand_windows, window_store
from evenstep.schema import FRAME_START, SERIES, SPLIT, TARGET_TS, TS, VALUE, Y, YHAT, all_of, keys_of
from evenstep.sources.storage import settle, settle_bucketed


@dataclass(frozen=True)
class Recipe:
    """Steps, reaches and shares of one preparation. The defaults are for hourly load readings."""

    step: str | timedelta = "h"
    lags: tuple[int, ...] = (1, 2, 3, 24, 48, 168)
    rolling: tuple[int, ...] = (24, 168)
    sequence_length: int = 168
    horizon: int = 24
    season: int = 168
    ratios: tuple[float, float, float] = (0.7, 0.15, 0.15)
    steps_per_block: int | None = None

    def __post_init__(self) -> None:
        step_micros(self.step)
        require_periods(self.lags, self.rolling)
        require_ratios(*self.ratios)
        require_season(self.season, self.horizon)
        if self.sequence_length < 1 or self.horizon < 1:
            raise ValueError("sequence_length and horizon must be positive")

    @property
    def reach(self) -> int:
        return max([*self.lags, *self.rolling], default=0)

    @property
    def history(self) -> list[str]:
        return lag_names(self.lags, self.rolling)

    @property
    def features(self) -> list[str]:
        """Model inputs in order: the target, calendar columns, then history."""
        return [VALUE, *CALENDAR_NAMES, *self.history]


def divide(series: DataFrame, recipe: Recipe, check: bool = True) -> DataFrame:
    return chronological_split(series, *recipe.ratios, step=recipe.step, check=check)


def stored_blocks(divided: DataFrame, recipe: Recipe) -> DataFrame:
    """A divided series in blocks that see as far as the recipe does, stored so that features, targets or both are
    built from it, as often as need be, without another shuffle. Give it to them as ``blocks``.
    """
    blocked = to_blocks(with_frame_start(divided), step_micros(recipe.step), recipe.reach, recipe.horizon, recipe.steps_per_block)
    return settle_bucketed(blocked, [*keys_of(divided), BLOCK, PHASE])


def _lagged(divided: DataFrame, recipe: Recipe, blocks: DataFrame | None = None) -> DataFrame:
    step = step_micros(recipe.step)
    blocked = blocks if blocks is not None else to_blocks(with_frame_start(divided), step, recipe.reach, 0, recipe.steps_per_block)
    return home_rows(add_lags(blocked, recipe.lags, recipe.rolling, step))


def feature_frame(divided: DataFrame, recipe: Recipe, blocks: DataFrame | None = None) -> DataFrame:
    """Calendar, lag and rolling columns per slice; rows with a null in any of them are dropped."""
    kept = with_history(_lagged(divided, recipe, blocks), recipe.lags, recipe.rolling)
    return add_calendar(kept).select(*keys_of(kept), FRAME_START, TS, *recipe.features)


def supervised_frame(divided: DataFrame, recipe: Recipe, blocks: DataFrame | None = None) -> DataFrame:
    """``feature_frame`` plus ``y`` and ``target_ts``, in one shuffle.

    Futures are taken over the rows that survive the null drop, so a row lost to incomplete history also
    breaks its neighbours' futures. The halo therefore spans history behind and horizon in front: rows in
    front of a block have their own history inside it, and both passes run on the same blocks.
    """
    step = step_micros(recipe.step)
    blocked = blocks if blocks is not None else to_blocks(with_frame_start(divided), step, recipe.reach, recipe.horizon, recipe.steps_per_block)
    kept = with_history(add_lags(blocked, recipe.lags, recipe.rolling, step), recipe.lags, recipe.rolling)
    paired = home_rows(add_targets(kept, recipe.horizon, step)).where(F.size(Y) == recipe.horizon)
    return add_calendar(paired).select(*keys_of(paired), TS, TARGET_TS, *recipe.features, Y)


@dataclass(frozen=True)
class Prepared:
    """Scaled inputs for every model, with the statistics that scaled them, and what the passes counted by split.

    ``counts`` has, for each split, ``rows``, ``holiday_rows`` and ``incomplete_rows`` (before rows with incomplete history
    go), ``feature_rows``, ``target_rows`` and ``windows``.
    """

    scaler: SeriesScaler
    tabular: DataFrame
    store: DataFrame
    sequence: DataFrame
    series: DataFrame
    counts: dict[str, dict[str, int]]


class _Counted:
    """Counts by split, taken while a frame is written."""

    def __init__(self, **numbers: Column) -> None:
        self.numbers, self.seen = numbers, Observation()

    def watch(self, frame: DataFrame) -> DataFrame:
        wanted = [
            F.sum(F.when(F.col(SPLIT) == split, number.cast("bigint"))).alias(f"{name} {split}")
            for name, number in self.numbers.items()
            for split in SPLITS
        ]
        return frame.observe(self.seen, *wanted)

    def by_split(self) -> dict[str, dict[str, int]]:
        found = self.seen.get
        return {split: {name: found.get(f"{name} {split}") or 0 for name in self.numbers} for split in SPLITS}


def prepare(series: DataFrame, recipe: Recipe, check: bool = True) -> Prepared:
    """Split, build features, fit the scaler on training rows, scale, and draw both datasets from that.

    The feature frame feeds three consumers, so it is stored once; so are the rows with targets and the windows (as
    a ``window_store``). The audits are counted in the passes that write these tables, without a job of their own.
    """
    divided = divide(series, recipe, check)
    lagged = add_calendar(_lagged(divided, recipe))
    complete = all_of([F.col(name).isNotNull() for name in recipe.history])
    audit = _Counted(rows=F.lit(1), holiday_rows=F.col("is_holiday") == 1, incomplete_rows=~complete)
    history = _Counted(feature_rows=F.lit(1))
    kept = with_history(audit.watch(lagged), recipe.lags, recipe.rolling)
    features = settle(history.watch(kept.select(*keys_of(kept), FRAME_START, TS, *recipe.features)))
    scaler = SeriesScaler(scale_columns(features)).fit(features, check)
    scaled = scaler.transform(features)
    step = step_micros(recipe.step)
    blocked = to_blocks(scaled, step, 0, recipe.horizon, recipe.steps_per_block)
    targets, windows = _Counted(target_rows=F.lit(1)), _Counted(windows=F.size("windows"))
    paired = home_rows(add_targets(blocked, recipe.horizon, step)).where(F.size(Y) == recipe.horizon)
    tabular = settle(targets.watch(paired.drop(FRAME_START)))
    lengths = recipe.sequence_length, recipe.horizon, recipe.step
    stored = window_store(scaled, *lengths, check=check, steps_per_block=recipe.steps_per_block)
    store = settle(windows.watch(stored))
    counted = [c.by_split() for c in (audit, history, targets, windows)]
    counts = {split: {k: v for found in counted for k, v in found[split].items()} for split in SPLITS}
    return Prepared(scaler, tabular, store, expand_windows(store, *lengths), series, counts)


def naive_forecast(series: DataFrame, recipe: Recipe, split: str = "test", check: bool = True) -> DataFrame:
    """Rows of one split with their true future ``y`` and the seasonal naive ``yhat``, in original units."""
    divided = divide(series, recipe, check)
    scored = supervised_frame(divided.where(F.col(SPLIT) == split), recipe)
    return seasonal_naive(
        scored.select(SERIES, SPLIT, TS, TARGET_TS, Y), series, recipe.horizon, recipe.season, recipe.step,
        check, recipe.steps_per_block,
    )


Forecaster = LinearForecaster | TreeForecaster


#: Name, kind and settings of a learner.
Roster = dict[str, tuple[str, dict]]


def fit_roster(train: DataFrame, recipe: Recipe, roster: Roster | None = None) -> dict[str, Forecaster]:
    """The linear model and every learner of a roster (the presets) on the same stored training rows."""
    models: dict[str, Forecaster] = {"linear_regression": fit_linear(train, recipe.features, recipe.horizon)}
    for name, (kind, settings) in (PRESETS if roster is None else roster).items():
        models[name] = fit_trees(train, kind, recipe.features, recipe.horizon, **settings)
    return models


def leaderboard(
    series: DataFrame, recipe: Recipe, roster: Roster | None = None, check: bool = True
) -> DataFrame:
    """``[model, n, unscored, rmse, improvement_pct]`` on the test split, in original units, against the naive bar.

    All models are scored on the same rows, those that the naive forecast can answer, side by side in one pass.
    With ``check`` it has to answer all rows; otherwise ``unscored`` counts those it cannot.
    """
    rows = settle(supervised_frame(divide(series, recipe, check), recipe))
    train, test = rows.where(F.col(SPLIT) == "train"), rows.where(F.col(SPLIT) == "test")
    naive_name = f"seasonal_naive_{recipe.season}h"
    board = settle(seasonal_naive(test, series, recipe.horizon, recipe.season, recipe.step, check))
    board, forecasts = board.withColumnRenamed(YHAT, "_naive"), {naive_name: "_naive"}
    for at, (name, model) in enumerate(fit_roster(train, recipe, roster).items()):
        forecasts[name] = f"_forecast_{at}"
        predicted = model.predict(board)
        answered = F.when(F.col("_naive").isNotNull(), F.col(YHAT))
        board = predicted.withColumn(forecasts[name], answered).drop(YHAT)
    return improvement_over(scores(board, forecasts), naive_name)
