"""Rows without a key, surplus fields and failed writes: nothing may vanish or double."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evenstep.errors import DataValidationError, RegistryError
from evenstep.functions.calendar import with_frame_start
from evenstep.models.linear import fit_linear
from evenstep.operators.evaluation import rmse
from evenstep.operators.grid import complete_grid, missing_stamps
from evenstep.operators.lags import lag_disagreement, number_rows
from evenstep.operators.quality import arrival_disorder, validate, validation_report
from evenstep.operators.splitting import chronological_split, tail_holdout
from evenstep.operators.windows import gap_segments
from evenstep.sources.observations import read_csv
from evenstep.sources.params import ModelMeta, _claim, load_registered, register

START = datetime(2021, 5, 1)
HOUR = 3_600_000_000


@pytest.fixture
def half_keyed(spark):
    rows = [(s, START + timedelta(hours=i), float(i), i) for s in ("a", None) for i in range(10) if i != 4]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double, n long")


def _same(frame, expected_rows=9):
    counts = {r.series_id: r["count"] for r in frame.groupBy("series_id").count().collect()}
    assert counts == {"a": expected_rows, None: expected_rows}


def test_splits_keep_rows_without_a_key(half_keyed):
    divided = chronological_split(half_keyed, check=False)
    _same(divided)
    assert divided.where("frame_start is null").count() == 0


def test_segments_numbers_and_starts_keep_rows_without_a_key(half_keyed):
    segments = gap_segments(half_keyed)
    _same(segments)
    assert segments.where("series_id is null").agg(F.max("segment")).first()[0] == 2
    _same(number_rows(half_keyed, HOUR))
    assert with_frame_start(half_keyed).where(F.col("frame_start") == F.lit(START).cast("timestamp_ntz")).count() == 18


def test_grid_of_rows_without_a_key(half_keyed):
    grid = complete_grid(half_keyed, check=False)
    _same(grid, 10)
    assert grid.where("series_id is null and value is not null").count() == 9
    assert sorted(r.series_id or "" for r in missing_stamps(half_keyed).collect()) == ["", "a"]


def test_audits_and_holdout_count_rows_without_a_key(half_keyed):
    assert {r.rows for r in lag_disagreement(half_keyed, 2).collect()} == {9}
    assert {r.rows for r in arrival_disorder(half_keyed, ["n"]).collect()} == {9}
    _same(tail_holdout(half_keyed.withColumnRenamed("ts", "target_ts"), check=False))


def test_row_without_arrival_number_is_counted_apart(spark):
    rows = [("a", START + timedelta(hours=i), i) for i in range(5)] + [("a", START + timedelta(hours=99), None)]
    found = arrival_disorder(spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, n long"), ["n"]).first()
    assert (found.rows, found.late_rows, found.unnumbered_rows) == (6, 0, 1)


@pytest.mark.parametrize("scale", [1, 10**9])
def test_late_rows_do_not_depend_on_the_spacing_of_numbers(spark, scale):
    order = [5, 1, 4, 2, 8, 3, 9, 7]
    rows = [("a", START + timedelta(hours=h), i * scale) for i, h in enumerate(order)]
    frame = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, n long")
    assert arrival_disorder(frame, ["n"], rows_per_chunk=2).first().late_rows == 5


def test_report_names_late_rows_when_told_the_arrival(spark):
    rows = [("a", START + timedelta(hours=h), 1.0, i) for i, h in enumerate([0, 2, 1])]
    frame = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double, n long")
    assert validation_report(frame, min_rows=1).first().problems == []
    assert "1 rows arrived" in validation_report(frame, min_rows=1, arrival=["n"]).first().problems[0]


def test_empty_frame_is_refused(half_keyed):
    with pytest.raises(DataValidationError, match="fewer than 7 rows: 0"):
        validate(half_keyed.limit(0), min_rows=7)


def test_csv_row_with_a_surplus_field_fails(spark, tmp_path):
    path = tmp_path / "load.csv"
    path.write_text("Datetime,LOAD\n2020-01-01 00:00:00,1\n2020-01-01 01:00:00,2,99\n")
    with pytest.raises(Exception, match="more fields than the header"):
        read_csv(spark, path, "Datetime", "LOAD").collect()


def test_csv_row_with_a_field_less_lacks_its_value(spark, tmp_path):
    path = tmp_path / "load.csv"
    path.write_text("Datetime,LOAD\n2020-01-01 00:00:00,1\n2020-01-01 01:00:00\n")
    assert [r.value for r in read_csv(spark, path, "Datetime", "LOAD").orderBy("ts").collect()] == [1.0, None]


def test_unscored_rows_are_counted(spark):
    frame = spark.createDataFrame([([1.0, 2.0], [1.0, 4.0]), ([1.0, 1.0], None)], "y array<double>, yhat array<double>")
    found = rmse(frame).first()
    assert (found.n, found.unscored) == (2, 1) and found.rmse == pytest.approx(2**0.5)


@pytest.fixture
def model(spark):
    rows = [("a", float(i), [2.0 * i + 1]) for i in range(8)]
    return fit_linear(spark.createDataFrame(rows, "series_id string, x double, y array<double>"), ["x"], 1)


META = ModelMeta("m", "linear", ["x"], 1)


def test_failed_attempt_leaves_no_second_row(spark, tmp_path, model, monkeypatch):
    root = str(tmp_path / "registry")
    broken = ModelMeta("m", "linear", ["x"], 1, hyperparameters={"bad": {1, 2}})
    with pytest.raises(TypeError):
        register(root, model, broken, spark=spark)
    version = register(root, model, META, spark=spark)
    stored = load_registered(root, "m", version, spark)
    one = spark.createDataFrame([("a", 3.0)], "series_id string, x double")
    assert [round(r.yhat[0], 6) for r in stored.model.predict(one).collect()] == [7.0]


def test_two_writers_get_two_versions(spark, tmp_path, model):
    root = str(tmp_path / "registry")
    with ThreadPoolExecutor(2) as pool:
        versions = list(pool.map(lambda _: register(root, model, META, spark=spark), range(2)))
    assert sorted(versions) == ["1", "2"]
    assert not _claim(spark, root, "m", 1)


def test_unreadable_meta_is_not_taken_for_none(spark, tmp_path):
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "part.parquet").write_text("no parquet")
    with pytest.raises(Exception) as caught:
        load_registered(str(tmp_path), "m", spark=spark)
    assert not isinstance(caught.value, RegistryError)


def test_digits_of_a_window_do_not_hang_on_other_windows(spark):
    from evenstep.operators.lags import lag_features

    rows = [("a", START + timedelta(hours=i), 1e6 + (i * 7919 % 101) / 7.0) for i in range(400)]
    frame = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double")
    name = "rolling_std_168h"
    alone, beside = (
        {r.ts: r[name] for r in lag_features(frame, [], windows, check=False).collect()} for windows in ([168], [24, 84, 168])
    )
    assert alone == beside and sum(v is not None for v in alone.values()) == 232
