from datetime import datetime, timedelta

import pytest

from evenstep.errors import SequenceError, SplitError
from evenstep.operators.splitting import chronological_split, reassemble, split_bounds, split_summary, tail_holdout


def sizes(divided):
    return {r.split: r["rows"] for r in split_summary(divided).collect()}


@pytest.mark.parametrize("n, expected", [(1000, (700, 150, 150)), (997, (697, 149, 151)), (90, (62, 13, 15))])
@pytest.mark.parametrize("steps_per_block", [7, 16_384])
def test_positions_are_truncated_and_nothing_is_lost(ramp, n, expected, steps_per_block):
    got = sizes(chronological_split(ramp(n), steps_per_block=steps_per_block))
    assert (got["train"], got["validation"], got["test"]) == expected


def test_splits_are_in_order_and_do_not_overlap(ramp):
    parts = {r.split: r for r in split_summary(chronological_split(ramp(100, drop=(3, 50, 51)))).collect()}
    assert parts["train"].last_ts < parts["validation"].first_ts <= parts["validation"].last_ts < parts["test"].first_ts


def test_each_series_is_cut_at_its_own_stamps(ramp):
    panel = ramp(100).unionByName(ramp(20, series="b", start=datetime(2021, 1, 1)))
    got = {(r.series_id, r.split): r["rows"] for r in split_summary(chronological_split(panel)).collect()}
    assert got == {
        ("all", "train"): 70, ("all", "validation"): 15, ("all", "test"): 15,
        ("b", "train"): 14, ("b", "validation"): 3, ("b", "test"): 3,
    }


def test_frame_start_is_the_first_stamp_of_the_split(ramp):
    starts = {(r.split, r.frame_start) for r in chronological_split(ramp(20)).collect()}
    t = datetime(2020, 1, 1)
    assert starts == {("train", t), ("validation", t + timedelta(hours=14)), ("test", t + timedelta(hours=17))}


def test_empty_split_is_refused(ramp):
    with pytest.raises(SplitError, match="all \\(3 rows\\)"):
        chronological_split(ramp(3))


@pytest.mark.parametrize("ratios", [(0.7, 0.2, 0.2), (1.0, 0.0, 0.0), (0.5, 0.6, -0.1)])
def test_ratios_must_be_shares_of_one(ramp, ratios):
    with pytest.raises(SplitError):
        chronological_split(ramp(10), *ratios)
    assert split_bounds(ramp(10), 0.7, 0.2, 0.1).first().n == 10


def test_reassembled_parts_are_the_series(ramp):
    series = ramp(40)
    divided = chronological_split(series)
    parts = [divided.where(f"split = '{s}'") for s in ("train", "validation", "test")]
    assert sorted(map(tuple, reassemble(*parts).select(*series.columns).collect())) == sorted(map(tuple, series.collect()))


def test_tail_holdout_takes_the_last_windows(ramp):
    windows = ramp(25).withColumnRenamed("ts", "target_ts").select("series_id", "target_ts")
    got = tail_holdout(windows, 0.1)
    assert sorted(r.target_ts.hour for r in got.where("part = 'holdout' and target_ts >= '2020-01-01 22:00'").collect()) == [0, 22, 23]
    assert got.where("part = 'fit'").count() == 22
    with pytest.raises(SequenceError, match="empty side"):
        tail_holdout(windows, 0.0)


@pytest.mark.parametrize("lacking", ["series_id", "ts"])
def test_rows_without_a_key_are_refused_not_lost(spark, ramp, lacking):
    kind = {"series_id": "string", "ts": "timestamp_ntz"}[lacking]
    keyless = ramp(1).selectExpr(*[f"cast(null as {kind}) {c}" if c == lacking else c for c in ("series_id", "ts", "value")])
    with pytest.raises(SplitError, match="lacks its series or its stamp"):
        chronological_split(ramp(20).unionByName(keyless))


def test_a_series_with_most_rows_is_spread_over_tasks(spark, ramp):
    """A join on the series must not leave the hot series hashed by series alone when windows follow."""
    from pyspark.sql import functions as F

    from evenstep.operators.blocks import to_blocks

    panel = ramp(3000, series="hot").unionByName(ramp(100, series="a")).unionByName(ramp(100, series="b"))
    divided = chronological_split(panel)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        blocked = to_blocks(divided, 3_600_000_000, 24, 24, steps_per_block=100)
        home = blocked.where("_home")
        tasks = home.where("series_id = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
        assert home.count() == 3200 and tasks == 8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
