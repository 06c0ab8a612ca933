"""Registered queries: one per operator, over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evenstep.functions.calendar import calendar_features, holiday_dates
from evenstep.models.linear import fit_linear
from evenstep.models.naive import seasonal_naive
from evenstep.models.trees import fit_trees
from evenstep.operators.cleaning import clean, clean_audit, duplicate_stamps
from evenstep.operators.evaluation import improvement_over, rmse, rmse_by_step
from evenstep.operators.grid import complete_grid, missing_stamps
from evenstep.operators.lags import feature_audit, lag_disagreement, lag_features, lag_names
from evenstep.operators.quality import arrival_disorder, validate, validation_report
from evenstep.operators.scaling import SeriesScaler, scale_columns, split_drift
from evenstep.operators.splitting import reassemble, split_summary, tail_holdout
from evenstep.operators.targets import horizon_targets
from evenstep.operators.windows import (
    dataset_sizes,
    expand_windows,
    gap_segments,
    segment_lengths,
    sequence_windows,
    window_manifest,
    window_store,
)
from evenstep.plans.fixtures import (
    HOURLY,
    LONG,
    SHORT,
    daily_quantity,
    daily_quantity_by_status,
    hourly_events,
    order_versions,
    shipments_in_order_of_entry,
)
from evenstep.plans.preparation import Recipe, divide, feature_frame, leaderboard, naive_forecast, prepare, supervised_frame
from evenstep.schema import FRAME_START, SERIES, SPLIT, TARGET_TS, TS, VALUE, Y, YHAT, long_form, null_counts
from evenstep.sources.observations import observations, read_csv
from evenstep.sources.params import ModelMeta, latest_versions, load_registered, register
from evenstep.sources.storage import settle, shared_folder

Query = Callable[[SparkSession, str], DataFrame]

_DIGITS = 6
#: Learners of sizes that a query can fit, named after them. They are not the presets, whose 24 steps of 300 rounds
#: are tens of thousands of Spark jobs.
_SMALL_TREES = {
    "forest_20_trees_depth_6": ("forest", {"numTrees": 20, "maxDepth": 6}),
    "boosted_8_rounds_depth_6": ("gbt", {"maxIter": 8, "maxDepth": 6, "stepSize": 0.3}),
    "boosted_8_rounds_depth_4": ("gbt", {"maxIter": 8, "maxDepth": 4, "stepSize": 0.3}),
}
_TREE_RECIPE = Recipe(step="D", lags=(1, 2, 3, 7, 14), rolling=(7, 14), sequence_length=14, horizon=3, season=14)


def _rounded(frame: DataFrame, columns: list[str]) -> DataFrame:
    return frame.withColumns({c: _round(F.col(c)) for c in columns})


def _round(column: Column) -> Column:
    return F.round(column, _DIGITS)


def q_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return observations(events, "ts", "value", "event_type", source="events")


def q_clean_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(hourly_events(spark, sf_dir))


def q_clean_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_audit(hourly_events(spark, sf_dir))


def q_duplicate_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_stamps(hourly_events(spark, sf_dir))


def q_complete_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete_grid(settle(clean(hourly_events(spark, sf_dir))), HOURLY.step, check=False)


def q_missing_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_stamps(settle(clean(hourly_events(spark, sf_dir))), HOURLY.step)


def q_arrival_disorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrival_disorder(shipments_in_order_of_entry(spark, sf_dir), ["l_orderkey", "l_linenumber"])


def q_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = validation_report(clean(hourly_events(spark, sf_dir)), step="h")
    daily = validation_report(daily_quantity_by_status(spark, sf_dir), step="D")
    return hourly.unionByName(daily).select(
        SERIES, "rows", "missing_target_ratio", "missing_index_ratio", F.size("problems").alias("problem_count")
    )


def _divided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divide(settle(daily_quantity_by_status(spark, sf_dir)), SHORT, check=False)


def q_chronological_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _divided(spark, sf_dir).select(SERIES, SPLIT, TS, VALUE)


def q_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_summary(_divided(spark, sf_dir))


def q_split_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reassemble(_divided(spark, sf_dir)).select(SERIES, TS, VALUE)


def q_calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = clean(hourly_events(spark, sf_dir))
    stamps = hourly.select(SERIES, TS).unionByName(daily_quantity(spark, sf_dir).select(SERIES, TS))
    built = calendar_features(stamps)
    return _rounded(built, [c for c in built.columns if c.endswith(("_sin", "_cos"))])


def q_holiday_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holiday_dates(daily_quantity(spark, sf_dir)).withColumn("holiday", F.col("holiday").cast("string"))


def _hourly_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = settle(clean(hourly_events(spark, sf_dir)))
    return lag_features(series, HOURLY.lags, HOURLY.rolling, HOURLY.step, check=False)


def q_lag_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hourly_lags(spark, sf_dir).select(SERIES, TS, VALUE, *lag_names(HOURLY.lags, []))


def q_lag_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lag_disagreement(settle(clean(hourly_events(spark, sf_dir))), 3, HOURLY.step)


def q_rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolling = lag_names([], HOURLY.rolling)
    return _rounded(_hourly_lags(spark, sf_dir).select(SERIES, TS, *rolling), rolling)


def q_feature_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_audit(calendar_features(_hourly_lags(spark, sf_dir)))


def q_feature_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = feature_frame(_divided(spark, sf_dir), SHORT).drop(FRAME_START)
    return _rounded(frame, [c for c in frame.columns if c.endswith(("_sin", "_cos")) or c.startswith("rolling_")])


def q_null_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    lagged = lag_features(_divided(spark, sf_dir), SHORT.lags, SHORT.rolling, SHORT.step, check=False)
    return null_counts(lagged, [VALUE, *SHORT.history])


def q_horizon_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = supervised_frame(_divided(spark, sf_dir), SHORT)
    return long_form(rows, [SERIES, SPLIT, TS, TARGET_TS], Y, "value")


def q_horizon_targets_of_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = horizon_targets(settle(daily_quantity_by_status(spark, sf_dir)), SHORT.horizon, SHORT.step, check=False)
    return long_form(rows, [SERIES, TS, TARGET_TS], Y, "value")


def q_gap_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gap_segments(settle(daily_quantity_by_status(spark, sf_dir)), SHORT.step).select(SERIES, TS, "segment")


def q_segment_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = gap_segments(settle(daily_quantity_by_status(spark, sf_dir)), SHORT.step)
    return segment_lengths(segments, SHORT.sequence_length, SHORT.horizon)


def q_window_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = feature_frame(_divided(spark, sf_dir), SHORT)
    return window_manifest(frame, SHORT.sequence_length, SHORT.horizon, SHORT.step, check=False)


def q_sequence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = feature_frame(_divided(spark, sf_dir), SHORT)
    windows = sequence_windows(frame, SHORT.sequence_length, SHORT.horizon, SHORT.step, dtype="double", check=False)
    return _weighed(windows, SHORT)


def q_stored_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 168 steps and 24 ahead, from a store that holds every row about once."""
    lengths = LONG.sequence_length, LONG.horizon, LONG.step
    store = settle(window_store(_long_features(spark, sf_dir), *lengths, dtype="double", check=False))
    return _weighed(expand_windows(store, *lengths), LONG)


def _weighed(windows: DataFrame, recipe: Recipe) -> DataFrame:
    """Every window and column with the number of its values and their sum, each value times its step."""

    def cell(column: str, values: Column, first: int) -> Column:
        weighed = F.transform(values, lambda value, at: value * (at + first))
        total = F.aggregate(weighed, F.lit(0.0), lambda a, b: a + b)
        return F.struct(
            F.lit(column).alias("column"), F.size(values).cast("bigint").alias("values"), (F.round(total, 3) + F.lit(0.0)).alias("weighed")
        )

    def column(i: int) -> Column:
        return F.transform("x", lambda row: row[i])

    cells = [cell(name, column(i), 1) for i, name in enumerate(recipe.features)]
    ahead = cell("y", F.col("y"), recipe.sequence_length + 1)
    return windows.select(SERIES, SPLIT, "start_ts", TARGET_TS, F.inline(F.array(*cells, ahead)))


def q_tail_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = window_manifest(
        feature_frame(_divided(spark, sf_dir), SHORT), SHORT.sequence_length, SHORT.horizon, SHORT.step, check=False
    )
    train = settle(manifest.where(F.col(SPLIT) == "train"))
    return tail_holdout(train, 0.1, SHORT.step, check=False).select(SERIES, SPLIT, TARGET_TS, "part")


def q_dataset_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = settle(feature_frame(_divided(spark, sf_dir), SHORT))
    targets = horizon_targets(frame, SHORT.horizon, SHORT.step, check=False)
    windows = window_manifest(frame, SHORT.sequence_length, SHORT.horizon, SHORT.step, check=False)
    return dataset_sizes(frame, targets, windows)


def _long_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(feature_frame(divide(settle(daily_quantity(spark, sf_dir)), LONG, check=False), LONG))


def q_scaler_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = _long_features(spark, sf_dir)
    stats = SeriesScaler(scale_columns(features)).fit(features, check=False).stats()
    return _rounded(stats, ["mean", "std"])


def q_constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = _long_features(spark, sf_dir)
    return SeriesScaler().fit(features, check=False).constant_columns()


def q_scaled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = _long_features(spark, sf_dir)
    columns = scale_columns(features)
    scaled = SeriesScaler(columns).fit(features, check=False).transform(features)
    return _rounded(scaled.select(SERIES, SPLIT, TS, "hour", "dayofweek", *columns), columns)


def q_inverse_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = _long_features(spark, sf_dir)
    scaler = SeriesScaler(scale_columns(features)).fit(features, check=False)
    targets = horizon_targets(scaler.transform(features), LONG.horizon, LONG.step, check=False)
    restored = scaler.inverse_transform(targets.select(SERIES, SPLIT, TS, Y), [Y])
    return _rounded(long_form(restored, [SERIES, SPLIT, TS], Y, "value"), ["value"])


def q_split_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = _long_features(spark, sf_dir)
    scaled = SeriesScaler(scale_columns(features)).fit(features, check=False).transform(features)
    return _rounded(split_drift(scaled), ["mean_scaled"])


def _naive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive_forecast(settle(daily_quantity(spark, sf_dir)), LONG, check=False)


def q_seasonal_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_form(_naive_rows(spark, sf_dir), [SERIES, TS], YHAT, "yhat")


def q_naive_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rmse(_naive_rows(spark, sf_dir), [SERIES]), ["rmse"])


def q_rmse_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(rmse_by_step(_naive_rows(spark, sf_dir), LONG.horizon, [SERIES]), ["rmse"])


def _learned(spark: SparkSession, sf_dir: str, recipe: Recipe) -> tuple[DataFrame, DataFrame]:
    rows = settle(supervised_frame(divide(settle(daily_quantity(spark, sf_dir)), recipe, check=False), recipe))
    return rows.where(F.col(SPLIT) == "train"), rows.where(F.col(SPLIT) == "test")


def q_linear_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _learned(spark, sf_dir, LONG)
    forecast = fit_linear(train, LONG.features, LONG.horizon).predict(test)
    return _rounded(long_form(forecast, [SERIES, TS], YHAT, "yhat"), ["yhat"])


_ONE_LAG = ["lag_1h"]


def _in_hundredths(frame: DataFrame, column: str) -> DataFrame:
    return frame.withColumn(column, F.round(F.col(column), 2))


def q_linear_one_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _learned(spark, sf_dir, SHORT)
    forecast = fit_linear(train, _ONE_LAG, SHORT.horizon).predict(test)
    return _in_hundredths(long_form(forecast, [SERIES, TS], YHAT, "yhat"), "yhat")


_TWO_MEANS = ["lag_24h", "rolling_mean_24h"]


def q_linear_two_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two features and all 24 steps, fitted and scored at once."""
    train, test = _learned(spark, sf_dir, LONG)
    forecast = fit_linear(train, _TWO_MEANS, LONG.horizon).predict(test)
    return _in_hundredths(long_form(forecast, [SERIES, TS], YHAT, "yhat"), "yhat")


def q_linear_normal_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What least squares leaves over is at right angles to every feature: all moments are 0."""
    train, _ = _learned(spark, sf_dir, SHORT)
    fitted = settle(fit_linear(train, SHORT.features, SHORT.horizon).predict(train))
    left = [F.element_at(Y, h) - F.element_at(YHAT, h) for h in range(1, SHORT.horizon + 1)]
    moments = [
        F.struct(F.lit(h).alias("step"), F.lit(name).alias("feature"), F.try_divide(F.sum(F.col(name) * rest), F.sum(F.abs(F.col(name) * rest))).alias("moment"))
        for h, rest in enumerate(left, 1)
        for name in SHORT.features
    ]
    found = fitted.agg(F.array(*moments).alias("all")).select(F.inline("all"))
    return found.withColumn("moment", F.round(F.coalesce("moment", F.lit(0.0)), 6) + F.lit(0.0))


_ORDINALS = ["dayofweek", "month"]
_STUMP = {"numTrees": 1, "maxDepth": 1, "bootstrap": False, "featureSubsetStrategy": "all"}


def q_forest_stump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tree of one split on whole-number features: the split that lowers the variance most."""
    train, test = _learned(spark, sf_dir, SHORT)
    model = fit_trees(train, "forest", _ORDINALS, 1, **_STUMP)
    return _in_hundredths(long_form(model.predict(test), [SERIES, TS], YHAT, "yhat"), "yhat")


def q_boosted_stumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of boosting by trees of one split: the second is fitted to what the first leaves over."""
    train, test = _learned(spark, sf_dir, SHORT)
    model = fit_trees(train, "gbt", _ORDINALS, 1, maxIter=2, maxDepth=1, stepSize=0.5)
    return _in_hundredths(long_form(model.predict(test), [SERIES, TS], YHAT, "yhat"), "yhat")


def q_trees_register_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree model stored, brought back by its name and applied."""
    train, test = _learned(spark, sf_dir, SHORT)
    root = f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}"
    model = fit_trees(train, "forest", _ORDINALS, 1, **_STUMP)
    register(root, model, ModelMeta("stump", "forest", _ORDINALS, 1, hyperparameters=_STUMP), spark=spark)
    stored = load_registered(root, "stump", spark=spark)
    return _in_hundredths(long_form(stored.model.predict(test), [SERIES, TS], YHAT, "yhat"), "yhat")


def q_leaderboard_naive_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _learned(spark, sf_dir, SHORT)
    series = settle(daily_quantity(spark, sf_dir))
    bar = settle(seasonal_naive(test, series, SHORT.horizon, SHORT.season, SHORT.step, check=True))
    linear = fit_linear(train, _ONE_LAG, SHORT.horizon).predict(bar.drop(YHAT))
    scores = [rmse(frame).withColumn("model", F.lit(name)) for name, frame in (("naive", bar), ("linear", linear))]
    return _in_hundredths(improvement_over(scores[0].unionByName(scores[1]), "naive"), "rmse")


def q_scaled_register_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain: clean, validate, split, features, scale, fit, register, reload, predict, back to units."""
    series = settle(clean(daily_quantity(spark, sf_dir)))
    validate(series, min_rows=100, step=SHORT.step, allow_missing_index=0.5)
    prepared = prepare(series, SHORT, check=False)
    train = settle(prepared.tabular.where(F.col(SPLIT) == "train"))
    model = fit_linear(train, _ONE_LAG, SHORT.horizon)
    root = f"{shared_folder(spark)}/registry-{uuid.uuid4().hex}"
    version = register(root, model, ModelMeta("one_lag", "linear", _ONE_LAG, SHORT.horizon), prepared.scaler, spark)
    stored = load_registered(root, "one_lag", version, spark)
    predicted = stored.model.predict(prepared.tabular.where(F.col(SPLIT) == "test"))
    restored = stored.scaler.inverse_transform(predicted.select(SERIES, TS, YHAT), [YHAT])
    return _in_hundredths(long_form(restored, [SERIES, TS], YHAT, "yhat"), "yhat")


def q_prepared_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the passes of a preparation counted while they wrote its tables."""
    counts = prepare(settle(daily_quantity(spark, sf_dir)), SHORT, check=False).counts
    names = list(next(iter(counts.values())))
    return spark.createDataFrame([(split, *found.values()) for split, found in counts.items()], ", ".join(["split string", *(f"{n} long" for n in names)]))


def q_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as headed CSV and read back as a panel."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("string"), "value", "event_type").write.option("header", True).csv(path)
    return read_csv(spark, path, "ts", "value", "event_type")


def q_csv_two_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written to one folder with their columns in two orders, one of them with a column more, and read as one panel."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("string"))
    odd = F.col("event_id") % 2 == 1
    events.where(odd).select("ts", "value", "event_type").write.option("header", True).csv(path)
    events.where(~odd).select("event_type", "event_id", "value", "ts").write.option("header", True).mode("append").csv(path)
    return read_csv(spark, path, "ts", "value", "event_type")


def _tree_forecast(name: str) -> Query:
    kind, settings = _SMALL_TREES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        train, test = _learned(spark, sf_dir, _TREE_RECIPE)
        model = fit_trees(train, kind, _TREE_RECIPE.features, _TREE_RECIPE.horizon, **settings)
        return _rounded(long_form(model.predict(test), [SERIES, TS], YHAT, "yhat"), ["yhat"])

    return run


def q_forecast_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    series = settle(daily_quantity(spark, sf_dir))
    return _rounded(leaderboard(series, _TREE_RECIPE, _SMALL_TREES, check=False), ["rmse"])


def q_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_versions(order_versions(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily totals split in time, features and targets per split, naive forecast, error per step."""
    series = settle(daily_quantity(spark, sf_dir))
    return rmse_by_step(naive_forecast(series, SHORT, check=False), SHORT.horizon, [SERIES])


QUERIES: dict[str, Query] = {
    "observations": q_observations,
    "clean_hourly": q_clean_hourly,
    "clean_audit": q_clean_audit,
    "duplicate_stamps": q_duplicate_stamps,
    "complete_grid": q_complete_grid,
    "missing_stamps": q_missing_stamps,
    "arrival_disorder": q_arrival_disorder,
    "validation_report": q_validation_report,
    "chronological_split": q_chronological_split,
    "split_summary": q_split_summary,
    "split_union": q_split_union,
    "calendar_features": q_calendar_features,
    "holiday_dates": q_holiday_dates,
    "lag_features": q_lag_features,
    "lag_disagreement": q_lag_disagreement,
    "rolling_features": q_rolling_features,
    "feature_audit": q_feature_audit,
    "feature_frame": q_feature_frame,
    "null_columns": q_null_columns,
    "horizon_targets": q_horizon_targets,
    "horizon_targets_of_series": q_horizon_targets_of_series,
    "gap_segments": q_gap_segments,
    "segment_lengths": q_segment_lengths,
    "window_manifest": q_window_manifest,
    "sequence_windows": q_sequence_windows,
    "stored_windows": q_stored_windows,
    "tail_holdout": q_tail_holdout,
    "dataset_sizes": q_dataset_sizes,
    "scaler_fit": q_scaler_fit,
    "constant_columns": q_constant_columns,
    "scaled_features": q_scaled_features,
    "inverse_scaled": q_inverse_scaled,
    "split_drift": q_split_drift,
    "seasonal_naive": q_seasonal_naive,
    "naive_rmse": q_naive_rmse,
    "rmse_by_step": q_rmse_by_step,
    "linear_forecast": q_linear_forecast,
    "forest_forecast": _tree_forecast("forest_20_trees_depth_6"),
    "gbt_forecast": _tree_forecast("boosted_8_rounds_depth_6"),
    "gbt_shallow_forecast": _tree_forecast("boosted_8_rounds_depth_4"),
    "forecast_leaderboard": q_forecast_leaderboard,
    "latest_version": q_latest_version,
    "linear_one_lag": q_linear_one_lag,
    "linear_two_features": q_linear_two_features,
    "linear_normal_equations": q_linear_normal_equations,
    "prepared_counts": q_prepared_counts,
    "forest_stump": q_forest_stump,
    "boosted_stumps": q_boosted_stumps,
    "trees_register_reload": q_trees_register_reload,
    "leaderboard_naive_linear": q_leaderboard_naive_linear,
    "scaled_register_reload": q_scaled_register_reload,
    "csv_roundtrip": q_csv_roundtrip,
    "csv_two_headers": q_csv_two_headers,
}
