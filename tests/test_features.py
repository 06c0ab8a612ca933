import math
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pandas.tseries.holiday import USFederalHolidayCalendar
from pyspark.sql import functions as F

from evenstep.errors import FeatureError, SequenceError, TargetError
from evenstep.functions.calendar import CALENDAR_NAMES, calendar_features, holiday_dates, is_federal_holiday
from evenstep.functions.stamps import floor_stamp, stamp_micros, step_micros
from evenstep.operators.lags import feature_audit, lag_disagreement, lag_features, number_rows
from evenstep.operators.splitting import chronological_split
from evenstep.operators.targets import horizon_targets
from evenstep.operators.windows import gap_segments, segment_lengths, sequence_windows, window_manifest
from evenstep.schema import null_counts

START = datetime(2020, 1, 1)


def by_hour(df):
    return {int((r.ts - START) / timedelta(hours=1)): r for r in df.collect()}


# stamps


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_stamps_do_not_depend_on_the_session_zone(spark, zone):
    texts = ["2020-03-08 02:30:00", "2020-07-01 12:00:00.123456", "1969-12-31 23:59:59.5", "2020-11-01 01:30:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"))
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = df.select(stamp_micros("ts").alias("m"), floor_stamp("ts", "h").cast("string").alias("h")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [r.m for r in got] == [pd.Timestamp(t).value // 1000 for t in texts]
    assert [r.h for r in got] == [str(pd.Timestamp(t).floor("h")) for t in texts]


def test_steps_have_a_fixed_length():
    assert step_micros("h") == 3_600_000_000 and step_micros(timedelta(minutes=15)) == 900_000_000
    with pytest.raises(ValueError, match="fixed length"):
        step_micros("M")


# calendar


def test_holidays_agree_with_the_published_calendar(spark):
    days = spark.sql("select explode(sequence(date'1971-01-01', date'2035-12-31')) d")
    got = {r.d for r in days.where(is_federal_holiday(F.col("d"))).collect()}
    assert got == {d.date() for d in USFederalHolidayCalendar().holidays("1971-01-01", "2035-12-31")}


def test_calendar_columns_in_order(ramp):
    built = calendar_features(ramp(48))
    assert built.columns == ["series_id", "ts", "value", *CALENDAR_NAMES]
    rows = by_hour(built)
    assert (rows[23].hour, rows[0].dayofweek, rows[0].month) == (23, 2, 1)
    near = math.dist((rows[23].hour_sin, rows[23].hour_cos), (rows[0].hour_sin, rows[0].hour_cos))
    assert near == pytest.approx(math.dist((rows[1].hour_sin, rows[1].hour_cos), (rows[0].hour_sin, rows[0].hour_cos)))
    assert (rows[0].month_sin, rows[0].month_cos) == (0.0, 1.0)
    assert "is_holiday" not in calendar_features(ramp(3), holidays=False).columns


def test_first_day_is_flagged_only_when_it_begins_at_midnight(ramp):
    assert {r.is_holiday for r in calendar_features(ramp(24)).collect()} == {1}
    assert {r.is_holiday for r in calendar_features(ramp(5, start=datetime(2020, 1, 1, 5))).collect()} == {0}


def test_weekend_and_holiday_dates(ramp):
    daily = ramp(400, step=timedelta(days=1))
    assert {r.dayofweek for r in calendar_features(daily).where("is_weekend = 1").collect()} == {5, 6}
    holidays = {r.holiday for r in holiday_dates(daily).collect()}
    assert date(2020, 12, 25) in holidays and date(2020, 12, 24) not in holidays


# lags


def test_lag_is_time_not_rows(ramp):
    rows = by_hour(lag_features(ramp(100, drop=(24,)), [24], []))
    assert rows[48].lag_24h is None and rows[49].lag_24h == 25.0 and rows[23].lag_24h is None


def test_rolling_excludes_the_row_and_needs_every_step(ramp):
    rows = by_hour(lag_features(ramp(60, drop=(20,)), [], [3]))
    assert rows[50].rolling_mean_3h == 48.0 and rows[50].rolling_std_3h == 1.0
    assert [h for h in range(60) if h in rows and rows[h].rolling_mean_3h is None] == [0, 1, 2, 21, 22, 23]


def test_null_readings_break_history(ramp):
    rows = by_hour(lag_features(ramp(20, null=(5,)), [1], [2]))
    assert rows[6].lag_1h is None and rows[7].rolling_mean_2h is None and rows[8].rolling_mean_2h == 6.5


@pytest.mark.parametrize("windows", [[24, 168], [2, 37, 100], [1100]])
def test_long_windows_equal_pandas(spark, windows):
    rng = np.random.default_rng(7)
    n = 1500
    values = 1e5 + rng.normal(size=n) * np.where(np.arange(n) < 700, 1e-3, 50.0)
    values[200:400] = 123.456
    keep = ~np.isin(np.arange(n), [450, 451, 900])
    index = pd.date_range(START, periods=n, freq="h")
    pdf = pd.DataFrame({"series_id": "all", "ts": index, "value": values})[keep]
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    got = lag_features(df, [], windows).toPandas().set_index("ts").sort_index()
    grid = pd.Series(values, index).where(keep)
    for w in windows:
        frames = np.lib.stride_tricks.sliding_window_view(grid.to_numpy(), w)[:-1]
        mean, std = frames.mean(axis=1), frames.std(axis=1, ddof=1)
        expected = pd.DataFrame({"mean": mean, "std": std}, index[w:]).reindex(got.index)
        np.testing.assert_allclose(got[f"rolling_mean_{w}h"], expected["mean"], rtol=1e-12)
        np.testing.assert_allclose(got[f"rolling_std_{w}h"], expected["std"], rtol=1e-7, atol=1e-9)


def test_off_grid_rows_neither_give_nor_get(ramp):
    odd = ramp(1, start=datetime(2020, 1, 1, 4, 30))
    got = {r.ts: r for r in lag_features(ramp(10).unionByName(odd), [1], [2]).collect()}
    assert got[datetime(2020, 1, 1, 4, 30)].lag_1h is None
    assert got[datetime(2020, 1, 1, 5)].lag_1h == 4.0 and got[datetime(2020, 1, 1, 6)].rolling_mean_2h == 4.5


@pytest.mark.parametrize("steps_per_block", [1, 5, 64])
def test_answers_do_not_depend_on_the_block_size(ramp, steps_per_block):
    frame = ramp(150, drop=(20, 21, 77))
    whole = sorted(map(tuple, lag_features(frame, [1, 5], [4, 40], steps_per_block=10**6).collect()))
    assert sorted(map(tuple, lag_features(frame, [1, 5], [4, 40], steps_per_block=steps_per_block).collect())) == whole
    futures = lambda b: sorted((r.ts, r.y) for r in horizon_targets(frame, 6, steps_per_block=b).collect())
    assert futures(steps_per_block) == futures(10**6)
    windows = lambda b: sorted((r.start_ts, r.x, r.y) for r in sequence_windows(frame, 4, 3, steps_per_block=b).collect())
    assert windows(steps_per_block) == windows(10**6)
    segments = lambda b: sorted((r.ts, r.segment) for r in gap_segments(frame, steps_per_block=b).collect())
    assert segments(steps_per_block) == segments(10**6)


def test_history_never_crosses_a_split(ramp):
    lagged = lag_features(chronological_split(ramp(100)), [1], [5])
    first = lagged.where("ts = frame_start")
    assert first.count() == 3 and first.where("lag_1h is not null").count() == 0


def test_lag_arguments_and_guards(ramp):
    with pytest.raises(FeatureError, match="at least one step"):
        lag_features(ramp(3), [0], [])
    with pytest.raises(FeatureError, match="at least two steps"):
        lag_features(ramp(3), [1], [1])
    with pytest.raises(FeatureError, match="no column 'load'"):
        lag_features(ramp(3), [1], [], target="load")
    with pytest.raises(FeatureError, match="occurs 2 times"):
        lag_features(ramp(3).unionByName(ramp(1)), [1], [])


def test_audits(ramp):
    frame = ramp(30, drop=(10,))
    row = feature_audit(calendar_features(lag_features(frame, [1], []))).first()
    assert (row["rows"], row.holiday_rows, row.incomplete_rows) == (29, 23, 2)
    positions = {r.ts.day * 24 + r.ts.hour - 24: r._row for r in number_rows(frame, step_micros("h"), 4).collect()}
    assert [positions[h] for h in sorted(positions)] == list(range(29))


@pytest.mark.parametrize("rows_per_chunk", [2, 4096])
def test_positional_lag_disagrees_after_a_gap(ramp, rows_per_chunk):
    got = lag_disagreement(ramp(30, drop=(10,)), 3, rows_per_chunk=rows_per_chunk).first()
    # Rows 11 and 12 read too far back; row 13 would read the missing hour, so only its neighbours count.
    assert (got["rows"], got.disagreeing_rows) == (29, 2)


# targets


def test_targets_are_the_next_steps(ramp):
    rows = by_hour(horizon_targets(ramp(100), 3))
    assert len(rows) == 97 and rows[0].y == [1.0, 2.0, 3.0] and rows[0].target_ts == START + timedelta(hours=1)


def test_rows_before_a_gap_have_no_future(ramp):
    rows = by_hour(horizon_targets(ramp(20, drop=(10,)), 3))
    assert sorted(rows) == [0, 1, 2, 3, 4, 5, 6] + list(range(11, 17))


def test_target_refusals(ramp):
    with pytest.raises(TargetError, match="unbroken run"):
        horizon_targets(ramp(3), 5)
    with pytest.raises(TargetError, match="value"):
        horizon_targets(ramp(9, null=(2,)), 2)
    with pytest.raises(TargetError, match="positive"):
        horizon_targets(ramp(9), 0)


# windows


def test_windows_have_lookback_then_horizon(ramp):
    frame = ramp(100).withColumn("double_value", F.col("value") * 2)
    got = {r.start_ts: r for r in sequence_windows(frame, 4, 2).collect()}
    assert len(got) == 95
    first = got[START]
    assert first.x == [[0.0, 0.0], [1.0, 2.0], [2.0, 4.0], [3.0, 6.0]] and first.y == [4.0, 5.0]
    assert first.target_ts == START + timedelta(hours=4)


def test_no_window_spans_a_gap(ramp):
    manifest = window_manifest(ramp(100, drop=(50,)), 4, 2)
    assert manifest.count() == 45 + 44
    assert manifest.where("start_ts <= '2020-01-03 02:00' and end_ts >= '2020-01-03 02:00'").count() == 0


def test_windows_follow_neighbours_not_the_grid(ramp):
    half_past = ramp(10, start=datetime(2020, 1, 2, 0, 30))
    assert window_manifest(ramp(10).unionByName(half_past), 4, 2).count() == 10
    crowded = ramp(6).unionByName(ramp(1, start=datetime(2020, 1, 1, 2, 30)))
    with pytest.raises(SequenceError, match="unbroken run"):
        window_manifest(crowded, 4, 2)


def test_segments_and_their_lengths(ramp):
    segments = gap_segments(ramp(20, drop=(5, 12, 13)), steps_per_block=4)
    got = sorted(map(tuple, segment_lengths(segments, 4, 2).select("segment", "rows", "windows", "too_short").collect()))
    assert got == [(1, 5, 0, True), (2, 6, 1, False), (3, 6, 1, False)]


def test_window_refusals(ramp):
    with pytest.raises(SequenceError, match="value"):
        sequence_windows(ramp(20, null=(3,)), 4, 2)
    with pytest.raises(SequenceError, match="positive"):
        sequence_windows(ramp(20), 0, 2)


def test_null_counts(ramp):
    assert {r["column"]: r.null_rows for r in null_counts(ramp(9, null=(1, 2))).collect()} == {"ts": 0, "value": 2}
