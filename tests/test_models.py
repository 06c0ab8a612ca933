import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenstep.errors import ForecastError, NaiveModelError, RegistryError, ScalerError
from evenstep.models.linear import fit_linear
from evenstep.models.naive import seasonal_naive
from evenstep.models.trees import fit_preset, fit_trees
from evenstep.operators.evaluation import improvement_over, rmse, rmse_by_step
from evenstep.operators.scaling import SeriesScaler, scale_columns, split_drift
from evenstep.operators.targets import horizon_targets
from evenstep.plans.preparation import (
    Recipe,
    divide,
    feature_frame,
    leaderboard,
    naive_forecast,
    prepare,
    supervised_frame,
)
from evenstep.sources.params import ModelMeta, latest_version, load_registered, register

START = datetime(2015, 1, 1)
SMALL = Recipe(lags=(1, 2, 24), rolling=(6, 24), sequence_length=24, horizon=4, season=24)


@pytest.fixture(scope="module")
def seasonal(spark):
    """Fifty days by the hour: a hump each day, flatter on two days in seven, on a slow drift, with steps of chance."""
    t = np.arange(1200)
    hump = np.clip(12 - np.abs(t % 24 - 14), 0, None) * np.where(t // 24 % 7 < 5, 30.0, 18.0)
    steps = np.random.default_rng(3).integers(-9, 10, len(t))
    values = 900 + hump + t / 40 + steps
    rows = [("all", START + timedelta(hours=int(i)), float(v)) for i, v in zip(t, values)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double")


@pytest.fixture(scope="module")
def prepared_rows(seasonal, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows") / "rows")
    supervised_frame(divide(seasonal, SMALL), SMALL).write.parquet(path)
    rows = seasonal.sparkSession.read.parquet(path)
    return rows.where("split = 'train'"), rows.where("split = 'test'")


# scaling


def test_scaler_uses_training_rows_alone(ramp):
    panel = divide(ramp(100), Recipe(lags=(1,), rolling=(2,), horizon=1, season=2))
    row = SeriesScaler(["value"]).fit(panel).stats().first()
    train = np.arange(70.0)
    assert (row["mean"], row["std"]) == (pytest.approx(train.mean()), pytest.approx(train.std(ddof=1)))


def test_scaling_and_back(ramp):
    panel = ramp(50).withColumn("other", F.lit(7.0)).withColumn("y", F.array("value", F.col("value") + 1))
    scaler = SeriesScaler(["value"]).fit(panel)
    scaled = scaler.transform(panel, arrays=["y"])
    assert {r.other for r in scaled.collect()} == {7.0}
    assert scaled.agg(F.avg("value"), F.stddev_samp("value")).first() == (pytest.approx(0), pytest.approx(1))
    back = scaler.inverse_transform(scaled, ["y", "value"]).orderBy("ts").collect()
    assert back[5].y == pytest.approx([5.0, 6.0]) and back[5].value == pytest.approx(5.0)


def test_each_series_has_its_own_statistics(ramp):
    panel = ramp(10).unionByName(ramp(10, series="b").withColumn("value", F.col("value") * 100))
    scaled = SeriesScaler().fit_transform(panel)
    assert {r.m for r in scaled.groupBy("series_id").agg(F.round(F.max("value"), 9).alias("m")).collect()} == {
        round((9 - 4.5) / np.arange(10.0).std(ddof=1), 9)
    }


def test_series_without_training_rows_keep_their_rows(ramp):
    scaler = SeriesScaler(["value"]).fit(ramp(10))
    assert scaler.transform(ramp(4, series="new")).where("value is null").count() == 4


def test_scaler_refusals(ramp):
    flat = ramp(10).withColumn("value", F.lit(3.0))
    with pytest.raises(ScalerError, match="constant"):
        SeriesScaler().fit(flat)
    assert SeriesScaler().fit(ramp(1)).stats().first()["std"] is None
    with pytest.raises(ScalerError, match="never called"):
        SeriesScaler().transform(flat)
    with pytest.raises(ScalerError, match="'load'"):
        SeriesScaler(["load"]).fit(flat)
    fitted = SeriesScaler(["value"]).fit(ramp(10))
    with pytest.raises(ScalerError, match="has no"):
        fitted.transform(ramp(3).drop("value"))
    with pytest.raises(ScalerError, match="no statistics"):
        fitted.inverse_transform(ramp(3), ["value"], column="load")
    with pytest.raises(ScalerError, match="standard"):
        SeriesScaler(kind="robust")


# naive


@pytest.mark.parametrize("steps_per_block", [1, 50, None])
def test_naive_reads_one_season_back(ramp, steps_per_block):
    series = ramp(400)
    scored = series.where("value >= 168")
    got = {r.value: r.yhat for r in seasonal_naive(scored, series, 3, steps_per_block=steps_per_block).collect()}
    assert len(got) == 232 and got[200.0] == [33.0, 34.0, 35.0]


def test_naive_refuses_rows_it_cannot_answer(ramp):
    series = ramp(400, drop=(30,))
    # Rows 0 to 166 without the missing 30, and the three rows that would read it.
    with pytest.raises(NaiveModelError, match="169 rows"):
        seasonal_naive(series, series, 3)
    lazy = {r.value: r.yhat for r in seasonal_naive(series, series, 3, check=False).collect()}
    assert lazy[10.0] is None and lazy[30 + 168 - 2.0] is None and lazy[200.0] == [33.0, 34.0, 35.0]
    with pytest.raises(NaiveModelError, match="longer than the horizon"):
        seasonal_naive(series, series, 24, season=24)


def test_naive_matches_stamps_exactly(ramp):
    half_past = ramp(60, start=datetime(2020, 1, 1, 0, 30)).withColumn("value", F.col("value") + 1000)
    both = ramp(60).unionByName(half_past)
    got = {r.value: r.yhat for r in seasonal_naive(both, both, 2, season=24, check=False).collect()}
    assert got[30.0] == [7.0, 8.0] and got[1030.0] == [1007.0, 1008.0]


# learned models


def test_linear_equals_least_squares(spark, prepared_rows):
    train, test = prepared_rows
    model = fit_linear(train, SMALL.features, SMALL.horizon)
    pdf, out = train.toPandas(), model.predict(test).toPandas()
    ones = lambda f: np.column_stack([np.ones(len(f)), f[SMALL.features].to_numpy(dtype=float)])
    weights, *_ = np.linalg.lstsq(ones(pdf), np.stack(pdf["y"].to_list()), rcond=None)
    np.testing.assert_allclose(np.stack(out["yhat"].to_list()), ones(out) @ weights, rtol=1e-6)


@pytest.mark.parametrize("tall", [40, 8192])
def test_linear_keeps_its_digits_at_a_high_condition(spark, monkeypatch, tall):
    from evenstep.models import linear

    monkeypatch.setattr(linear, "_TALL", tall)
    draw = np.random.default_rng(4)
    base = draw.normal(size=(600, 4))
    # The last column is the sum of two others but for a part in 1e9, after standardising too.
    columns = np.column_stack([base, base[:, 0] + base[:, 1] + 1e-9 * draw.normal(size=600)])
    outputs = columns @ draw.normal(size=(5, 2)) + draw.normal(size=(600, 2))
    centred = (columns - columns.mean(axis=0)) / columns.std(axis=0)
    assert 1e8 < np.linalg.cond(centred) < 1e10
    frame = spark.createDataFrame(
        [("a", *map(float, x), [float(v) for v in y]) for x, y in zip(columns, outputs)],
        "series_id string, a double, b double, c double, d double, e double, y array<double>",
    )
    model = fit_linear(frame, list("abcde"), 2)
    row = model.coefficients.first()
    # In the exact rotation both solve, predictions agree although the weights are huge.
    weights, *_ = np.linalg.lstsq(np.column_stack([np.ones(600), centred]), outputs, rcond=1e-13)
    want = np.column_stack([np.ones(600), centred]) @ weights
    got = np.array(row.intercept) + columns @ np.array(row.weights).T
    assert np.abs(got - want).max() < 1e-6 and np.linalg.norm(outputs - got) <= np.linalg.norm(outputs - want) * (1 + 1e-8)


def test_forecasts_of_many_outputs_stay_compiled(prepared_rows):
    train, test = prepared_rows
    plan = fit_linear(train, SMALL.features, SMALL.horizon).predict(test)._jdf.queryExecution().executedPlan().toString()
    assert "transform(" in plan and "_weights[" not in plan


def test_board_counts_the_rows_left_out(seasonal):
    # A short reach, so that rows whose season is missing are not lost to their own history.
    recipe = Recipe(lags=(1, 2), rolling=(6,), sequence_length=6, horizon=2, season=48)
    holes = seasonal.where("not (ts > '2015-02-16' and hour(ts) = 5 and day(ts) = 17)")
    rows = {r.model: r for r in leaderboard(holes, recipe, {}, check=False).collect()}
    assert {(r.n, r.unscored) for r in rows.values()} == {(rows["linear_regression"].n, rows["linear_regression"].unscored)}
    assert rows["linear_regression"].unscored > 0
    whole = {r.model: r for r in leaderboard(seasonal, recipe, {}).collect()}
    assert {r.unscored for r in whole.values()} == {0}


def test_linear_fits_each_series_and_survives_constant_and_collinear_columns(spark, ramp):
    def line(series, slope):
        return ramp(60, series=series).withColumn("value", F.col("value") * slope).withColumns(
            {"flat": F.lit(2.0), "twin": F.col("value") * 3}
        )

    rows = horizon_targets(line("a", 1.0).unionByName(line("b", -5.0)), 2)
    model = fit_linear(rows, horizon=2)
    for r in model.predict(rows).collect():
        assert r.yhat == pytest.approx(r.y, abs=1e-6)
    assert model.coefficients.count() == 2
    weights = {r.series_id: r.weights for r in model.coefficients.collect()}
    # Of value and its threefold twin the least-norm solution takes one part to three.
    assert weights["a"][0] == pytest.approx([0.1, 0.0, 0.3])


def test_feature_order_is_the_fitted_one(prepared_rows):
    train, test = prepared_rows
    model = fit_linear(train, SMALL.features, SMALL.horizon)
    turned = test.select("series_id", "ts", "y", *reversed(SMALL.features))
    both = [{r.ts: r.yhat for r in model.predict(f).collect()} for f in (test, turned)]
    assert both[0] == both[1]
    with pytest.raises(ForecastError, match="lag_24h"):
        model.predict(test.drop("lag_24h"))


def test_learned_models_beat_the_naive_bar(seasonal):
    roster = {
        "forest": ("forest", {"numTrees": 10, "maxDepth": 6}),
        "deep": ("gbt", {"maxIter": 5, "maxDepth": 5, "stepSize": 0.5}),
        "shallow": ("gbt", {"maxIter": 5, "maxDepth": 4, "stepSize": 0.5}),
    }
    recipe = Recipe(lags=(1, 2, 24), rolling=(6, 24), sequence_length=24, horizon=2, season=24)
    scores = {r.model: r for r in leaderboard(seasonal, recipe, roster).collect()}
    assert set(scores) == {"seasonal_naive_24h", "linear_regression", *roster}
    assert scores["seasonal_naive_24h"].improvement_pct == 0
    assert scores["linear_regression"].improvement_pct > 0
    assert scores["forest"].improvement_pct > 0


def test_trees_are_repeatable_and_refuse_unknown_names(prepared_rows):
    train, test = prepared_rows
    fit = lambda: fit_trees(train, "forest", SMALL.features, 1, numTrees=3, maxDepth=3).predict(test)
    first, second = ({r.ts: r.yhat for r in fit().collect()} for _ in range(2))
    assert first == second and all(len(v) == 1 and math.isfinite(v[0]) for v in first.values())
    with pytest.raises(ForecastError, match="stump"):
        fit_trees(train, "stump")
    with pytest.raises(ForecastError, match="unknown preset"):
        fit_preset(train, "catalogue")


# scores


def test_scores(spark):
    rows = spark.createDataFrame(
        [("a", [1.0, 2.0], [1.0, 4.0]), ("a", [0.0, 0.0], [2.0, 0.0]), ("a", [5.0, 5.0], None)],
        "series_id string, y array<double>, yhat array<double>",
    )
    assert (rmse(rows).first().n, rmse(rows).first().rmse) == (4, pytest.approx(math.sqrt(8 / 4)))
    assert {r.n for r in rmse_by_step(rows, 2).collect()} == {2}
    assert {r.step: r.rmse for r in rmse_by_step(rows, 2, ["series_id"]).collect()} == {
        1: pytest.approx(math.sqrt(2)), 2: pytest.approx(math.sqrt(2)),
    }
    scores = spark.createDataFrame([("bar", 200.0), ("m", 90.0)], "model string, rmse double")
    assert {r.model: r.improvement_pct for r in improvement_over(scores, "bar").collect()} == {"bar": 0, "m": 55}


# the whole chain


def test_preparation_isolates_splits(seasonal):
    got = prepare(seasonal, SMALL)
    sizes = {r.split: r["count"] for r in got.tabular.groupBy("split").count().collect()}
    assert set(sizes) == {"train", "validation", "test"}
    divided = divide(seasonal, SMALL)
    train_end = divided.where("split = 'train'").agg(F.max("ts")).first()[0]
    first_x = got.sequence.where("split = 'validation'").agg(F.min("start_ts")).first()[0]
    assert first_x > train_end
    x = got.sequence.first().x
    assert len(x) == 24 and len(x[0]) == len(SMALL.features)
    drift = {r.split: r.mean_scaled for r in split_drift(got.scaler.transform(feature_frame(divided, SMALL))).collect()}
    assert drift["train"] == pytest.approx(0, abs=1e-9)


def test_preparation_counts_in_the_passes_that_write(seasonal):
    from evenstep.functions.calendar import calendar_features
    from evenstep.operators.lags import feature_audit, lag_features
    from evenstep.operators.windows import window_manifest

    got = prepare(seasonal, SMALL)
    divided = divide(seasonal, SMALL)
    audit = {r.split: r for r in feature_audit(calendar_features(lag_features(divided, SMALL.lags, SMALL.rolling))).collect()}
    frame = feature_frame(divided, SMALL)
    count = lambda f: {r.split: r["count"] for r in f.groupBy("split").count().collect()}
    rows, targets, windows = count(frame), count(horizon_targets(frame, SMALL.horizon)), count(window_manifest(frame, 24, 4))
    for split, found in got.counts.items():
        told = audit[split]
        assert (found["rows"], found["holiday_rows"], found["incomplete_rows"]) == (told.rows, told.holiday_rows, told.incomplete_rows)
        assert (found["feature_rows"], found["target_rows"], found["windows"]) == (rows[split], targets[split], windows[split])


def test_scaled_targets_come_back_in_original_units(seasonal):
    got = prepare(seasonal, SMALL)
    back = {(r.split, r.ts): r.y for r in got.scaler.inverse_transform(got.tabular, ["y"]).collect()}
    plain = {(r.split, r.ts): r.y for r in supervised_frame(divide(seasonal, SMALL), SMALL).collect()}
    assert back.keys() == plain.keys()
    assert all(back[k] == pytest.approx(plain[k]) for k in plain)


def test_one_shuffle_equals_step_by_step(ramp):
    series = ramp(400, drop=(70, 71, 200))
    divided = divide(series, SMALL)
    stepwise = horizon_targets(feature_frame(divided, SMALL), SMALL.horizon)
    at_once = supervised_frame(divided, SMALL)
    key = lambda f: sorted((r.split, r.ts, r.target_ts, r.y, r.rolling_std_24h) for r in f.collect())
    assert key(at_once) == key(stepwise)
    blocky = Recipe(lags=(1, 2, 24), rolling=(6, 24), sequence_length=24, horizon=4, season=24, steps_per_block=3)
    assert key(supervised_frame(divided, blocky)) == key(stepwise)


def test_naive_reads_across_splits_and_scores_original_units(seasonal):
    rows = naive_forecast(seasonal, SMALL)
    values = {r.ts: r.value for r in seasonal.collect()}
    for r in rows.limit(20).collect():
        assert r.yhat == [values[r.ts + timedelta(hours=h - 24)] for h in range(1, 5)]


def test_recipe_arguments():
    for bad in ({"lags": (0,)}, {"rolling": (1,)}, {"horizon": 0}, {"sequence_length": 0}, {"season": 24}, {"step": "M"},
                {"ratios": (0.5, 0.5, 0.5)}):
        with pytest.raises(ValueError):
            Recipe(**bad)


# stored parameters


def test_models_come_back_with_scaler_and_feature_order(spark, tmp_path, prepared_rows):
    train, test = prepared_rows
    root = str(tmp_path / "registry")
    meta = ModelMeta("load-linear", "linear", SMALL.features, SMALL.horizon)
    scaler = SeriesScaler(scale_columns(train)).fit(train)
    model = fit_linear(train, SMALL.features, SMALL.horizon)
    assert [register(root, model, meta, scaler, spark) for _ in range(2)] == ["1", "2"]
    loaded = load_registered(root, "load-linear", spark=spark)
    assert loaded.version == "2" and loaded.meta == meta
    key = lambda f: sorted((r.ts, r.yhat) for r in f.collect())
    assert key(loaded.model.predict(test)) == key(model.predict(test))
    stats = lambda s: sorted(map(tuple, s.stats().collect()))
    assert stats(loaded.scaler) == stats(scaler)

    trees = fit_trees(train, "gbt", SMALL.features, 2, maxIter=2, maxDepth=2)
    tree_meta = ModelMeta("load-gbt", "gbt", SMALL.features, 2, hyperparameters={"maxIter": 2, "maxDepth": 2})
    assert register(root, trees, tree_meta, spark=spark) == "1"
    again = load_registered(root, "load-gbt", "1", spark)
    assert again.meta == tree_meta and again.scaler is None
    assert key(again.model.predict(test)) == key(trees.predict(test))
    with pytest.raises(RegistryError, match="no version"):
        load_registered(root, "other", spark=spark)


def test_latest_version_is_the_largest_number(spark, tmp_path):
    versions = spark.createDataFrame([("m", "9"), ("m", "10"), ("n", "2")], "name string, version string")
    assert latest_version(versions, "m") == "10"
    with pytest.raises(RegistryError, match="'x'"):
        latest_version(versions, "x")
    with pytest.raises(RegistryError, match="no version"):
        load_registered(str(tmp_path / "none"), "m", spark=spark)
