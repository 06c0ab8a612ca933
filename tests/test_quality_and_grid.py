from datetime import datetime, timedelta

import pytest

from evenstep.errors import DataValidationError, FeatureError
from evenstep.operators.grid import complete_grid, grid_stamps, missing_stamps
from evenstep.operators.quality import arrival_disorder, late_arrivals, validate, validation_report


def one(df):
    (row,) = df.collect()
    return row


def test_clean_series_has_no_problems(ramp):
    row = one(validate(ramp(1000)))
    assert (row.rows, row.missing_target_ratio, row.missing_index_ratio, row.problems) == (1000, 0.0, 0.0, [])


def test_every_rule_is_reported_in_one_run(ramp):
    row = one(validation_report(ramp(100, drop=range(10, 20), null=(3, 4))))
    assert row.rows == 90 and row.missing_target_ratio == 2 / 90 and row.missing_index_ratio == 10 / 100
    assert [p.split(":")[0].split(" ")[0] for p in row.problems] == ["fewer", "missing", "10"]


def test_limits_are_strict_and_independent(ramp):
    row = one(validation_report(ramp(100, drop=(5,)), min_rows=99, allow_missing_index=0.01))
    assert row.missing_index_ratio == 0.01 and row.problems == []
    with pytest.raises(DataValidationError, match="absent from the grid"):
        validate(ramp(100, drop=(5, 6)), min_rows=1, allow_missing_target=1.0)


def test_repeats_switch_the_gap_count_off(ramp):
    row = one(validation_report(ramp(10, drop=(4,)).unionByName(ramp(1)), min_rows=1))
    assert row.missing_index_ratio == 0.0 and row.problems == ["repeated stamps: 1"]


def test_off_grid_stamps_do_not_fill_gaps(ramp):
    shifted = ramp(1, start=datetime(2020, 1, 1, 2, 30))
    row = one(validation_report(ramp(4, drop=(2,)).unionByName(shifted), min_rows=1))
    assert row.missing_index_ratio == 0.25


def test_one_row_and_bad_arguments(ramp):
    assert one(validation_report(ramp(1), min_rows=1)).problems == []
    with pytest.raises(DataValidationError, match=r"\[0, 1\]"):
        validation_report(ramp(1), allow_missing_index=1.5)
    with pytest.raises(DataValidationError, match="'load'"):
        validation_report(ramp(1), target="load")


def test_many_faulty_series_are_counted_not_collected(spark):
    panel = spark.range(50).selectExpr("string(id) series_id", "timestamp_ntz'2020-01-01' ts", "1D value")
    with pytest.raises(DataValidationError, match="and 30 more series"):
        validate(panel)


@pytest.mark.parametrize("steps_per_block", [1, 3, 65_536])
def test_grid_is_complete_whatever_its_blocks(ramp, steps_per_block):
    panel = ramp(20, drop=(5, 6)).unionByName(ramp(3, series="b"))
    got = sorted((r.series_id, r.ts) for r in grid_stamps(panel, "h", steps_per_block).collect())
    start = datetime(2020, 1, 1)
    assert got == [("all", start + timedelta(hours=i)) for i in range(20)] + [("b", start + timedelta(hours=i)) for i in range(3)]


def test_grid_holds_null_where_nothing_was_shipped(ramp):
    got = {r.ts.hour: r.value for r in complete_grid(ramp(6, drop=(2, 3))).collect()}
    assert got == {0: 0.0, 1: 1.0, 2: None, 3: None, 4: 4.0, 5: 5.0}
    assert sorted(r.ts.hour for r in missing_stamps(ramp(6, drop=(2, 3))).collect()) == [2, 3]
    with pytest.raises(FeatureError, match="occurs 2 times"):
        complete_grid(ramp(3).unionByName(ramp(1)))


@pytest.mark.parametrize("rows_per_chunk", [1, 4, 1000])
def test_late_rows_by_running_maximum(spark, rows_per_chunk):
    days = [3, 1, 2, 5, 5, 4, 6, 0]
    raw = spark.createDataFrame(
        [("a", datetime(2020, 1, 1 + d), i) for i, d in enumerate(days)], "series_id string, ts timestamp_ntz, seq bigint"
    )
    late = {r.seq for r in late_arrivals(raw, ["seq"], rows_per_chunk).where("late").collect()}
    assert late == {i for i, d in enumerate(days) if i and d < max(days[:i])}
    row = one(arrival_disorder(raw, ["seq"], rows_per_chunk))
    assert (row["rows"], row.late_rows) == (8, 4)
