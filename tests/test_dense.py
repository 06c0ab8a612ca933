"""Readings denser than their step, bursts, and arrivals at one number: the same answers, and no crowded group."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from evenstep.models.naive import seasonal_naive
from evenstep.operators.blocks import BLOCK, PHASE, directory, to_blocks
from evenstep.operators.lags import lag_features, number_rows
from evenstep.operators.quality import arrival_disorder, arrival_parts, late_arrivals
from evenstep.operators.splitting import chronological_split, tail_holdout
from evenstep.operators.targets import horizon_targets
from evenstep.operators.windows import expand_windows, gap_segments, sequence_windows, window_manifest, window_store
from evenstep.schema import FRAME_START, SERIES, TS

START, SECOND, MINUTE = datetime(2021, 3, 1), timedelta(seconds=1), timedelta(minutes=1)
PANEL = "series_id string, ts timestamp_ntz, value double"
MINUTE_MICROS = 60_000_000


@pytest.fixture(scope="module")
def stamps():
    """Half an hour of seconds, then minutes with a gap, then a burst of milliseconds."""
    seconds = [START + i * SECOND for i in range(1800)]
    minutes = [START + i * MINUTE for i in range(30, 60) if i != 41]
    burst = [START + 60 * MINUTE + timedelta(milliseconds=i) for i in range(300)]
    return seconds + minutes + burst


@pytest.fixture(scope="module")
def dense(spark, stamps):
    rows = [(None if k % 2 else "a", t, float(i)) for k in range(2) for i, t in enumerate(stamps)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, PANEL)


def by_stamp(frame, column):
    return {(r.series_id, r.ts): r[column] for r in frame.collect()}


@pytest.mark.parametrize("most_rows", [7, 100, 10**6])
def test_blocks_of_a_directory_are_bounded_and_in_order(dense, most_rows):
    made = directory(dense, [SERIES], MINUTE_MICROS, steps_per_block=50, most_rows=most_rows)
    placed = made.place(dense).groupBy(SERIES, BLOCK).agg(F.count("*").alias("n"), F.min(TS).alias("low"), F.max(TS).alias("high"))
    rows = placed.orderBy(SERIES, BLOCK).collect()
    assert max(r.n for r in rows) <= most_rows
    assert all(a.high < b.low for a, b in zip(rows, rows[1:]) if a.series_id == b.series_id)
    counts = {(r.series_id, r[BLOCK]): r["_rows"] for r in made.counts.collect()}
    assert counts == {(r.series_id, r[BLOCK]): r.n for r in rows}


def test_one_stamp_cannot_be_divided(spark):
    panel = spark.createDataFrame([("a", START, 1.0)] * 50 + [("a", START + MINUTE, 1.0)], PANEL)
    made = directory(panel, [SERIES], MINUTE_MICROS, steps_per_block=10, most_rows=5)
    assert sorted(r["_rows"] for r in made.counts.collect()) == [1, 50]


@pytest.mark.parametrize("most_rows", [16, 10**6])
def test_numbers_segments_and_cuts(dense, stamps, most_rows):
    position = {t: i for i, t in enumerate(sorted(stamps))}
    numbered = by_stamp(number_rows(dense, MINUTE_MICROS, 50, most_rows), "_row")
    assert numbered == {(s, t): i for s in ("a", None) for t, i in position.items()}
    segments, segment, last = {}, 0, None
    for t in sorted(stamps):
        segment += last is None or t - last != MINUTE
        segments[t], last = segment, t
    got = by_stamp(gap_segments(dense, "min", 50, most_rows), "segment")
    assert got == {(s, t): n for s in ("a", None) for t, n in segments.items()}


def test_splits_and_holdouts(dense, stamps):
    cuts = sorted(stamps)
    n, n_train = len(cuts), int(len(cuts) * 0.7)
    got = by_stamp(chronological_split(dense, step="min", steps_per_block=3, check=False), "split")
    assert {t for (s, t), split in got.items() if split == "train" and s == "a"} == set(cuts[:n_train])
    held = tail_holdout(dense.withColumn("target_ts", F.col("ts")), 0.25, "min")
    assert sum(r.part == "holdout" for r in held.collect()) == 2 * (n - int(n * 0.75))


def test_history_futures_and_season_see_whole_steps_only(dense, stamps):
    known = {t: float(i) for i, t in enumerate(stamps)}
    on_grid = {t for t in known if (t - START) % MINUTE == timedelta(0)}
    lags = by_stamp(lag_features(dense, [1, 3], [2], "min", check=False), "lag_3h")
    assert lags == {(s, t): known.get(t - 3 * MINUTE) if t in on_grid else None for s in ("a", None) for t in known}
    futures = by_stamp(horizon_targets(dense, 2, "min", check=False), "y")
    want = {t: [known[t + MINUTE], known[t + 2 * MINUTE]] for t in on_grid if t + MINUTE in known and t + 2 * MINUTE in known}
    assert futures == {(s, t): y for s in ("a", None) for t, y in want.items()}
    season = by_stamp(seasonal_naive(dense, dense, 2, 5, "min", check=False), "yhat")
    for (_, t), yhat in season.items():
        asked = [known.get(t + h * MINUTE - 5 * MINUTE) for h in (1, 2)]
        assert yhat == (None if None in asked else asked)


def test_windows_lie_in_unbroken_runs(dense, stamps):
    run = [START + i * MINUTE for i in range(42, 60)]  # the burst begins one step after the last of these
    starts = {t for t in run + [START + 60 * MINUTE] if t + 3 * MINUTE in set(run) | {START + 60 * MINUTE}}
    early = [START + 1799 * SECOND]  # half a minute before the first whole minute: no run
    earlier_run = [START + i * MINUTE for i in range(30, 41)]
    starts |= {t for t in earlier_run if t + 3 * MINUTE <= earlier_run[-1]}
    assert not set(early) & starts
    manifest = window_manifest(dense, 3, 1, "min", check=False)
    assert {r.start_ts for r in manifest.collect()} == starts
    windows = sequence_windows(dense, 3, 1, "min", check=False, dtype="double").collect()
    known = {t: float(i) for i, t in enumerate(stamps)}
    assert {r.start_ts for r in windows} == starts and len(windows) == 2 * len(starts)
    for r in windows:
        assert [v for (v,) in r.x] == [known[r.start_ts + i * MINUTE] for i in range(3)] and r.y == [known[r.target_ts]]


def test_groups_of_dense_readings_are_bounded_by_steps(dense):
    blocked = to_blocks(dense.withColumn(FRAME_START, F.lit(START).cast("timestamp_ntz")), MINUTE_MICROS, 5, 5, steps_per_block=20)
    sizes = blocked.groupBy(SERIES, BLOCK, PHASE).count().agg(F.max("count")).first()[0]
    assert sizes <= 20 + 5 + 5
    plan = lag_features(dense, [1], [2], "min", check=False)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and BLOCK in line]
    assert exchanges and all(PHASE in line for line in exchanges)


def test_a_window_store_holds_rows_about_once(ramp):
    frame = ramp(6000, drop=(100, 3000))
    store = window_store(frame, 168, 24)
    held = store.agg(F.sum(F.size("x"))).first()[0]
    assert held <= 1.1 * 5998
    expanded = sorted(map(tuple, expand_windows(store, 168, 24).collect()))
    manifest = {(r.start_ts, r.target_ts) for r in window_manifest(frame, 168, 24).collect()}
    assert {(r[1], r[2]) for r in expanded} == manifest and len(expanded) == len(manifest)
    for row in expanded[:: len(expanded) // 50]:
        first = (row[1] - datetime(2020, 1, 1)) // timedelta(hours=1)
        assert row[3] == [[float(first + i)] for i in range(168)] and row[4] == [float(first + 168 + i) for i in range(24)]


def test_arrivals_at_one_number_are_spread(spark):
    draw = random.Random(2)
    rows = [("a", START + draw.randrange(10**6) * SECOND, 7, i) for i in range(20_000)]
    rows += [("b", START + i * SECOND, i, 0) for i in range(200)] + [("c", START, None, 0)]
    raw = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, minute bigint, line bigint")
    parts = [r["count"] for r in arrival_parts(raw.where("minute is not null"), ["minute", "line"], 1000).groupBy("_part").count().collect()]
    assert len(parts) >= 15 and max(parts) <= 3 * sorted(parts)[len(parts) // 2]
    seen, late = datetime.min, set()
    for _, t, _, line in rows[:20_000]:
        late |= {line} if t < seen else set()
        seen = max(seen, t)
    got = late_arrivals(raw, ["minute", "line"], 1000)
    assert {r.line for r in got.where("late and series_id = 'a'").collect()} == late
    counted = {r.series_id: (r["rows"], r.late_rows, r.unnumbered_rows) for r in arrival_disorder(raw, ["minute", "line"], 1000).collect()}
    assert counted == {"a": (20_000, len(late), 0), "b": (200, 0, 0), "c": (1, 0, 1)}
