"""Random gappy panels against definitions written out by hand, one stamp at a time."""

import math
import random
import statistics
from datetime import datetime, timedelta

import pytest

from evenstep.models.naive import seasonal_naive
from evenstep.operators.lags import lag_features
from evenstep.operators.splitting import chronological_split
from evenstep.operators.targets import horizon_targets
from evenstep.operators.windows import gap_segments, window_manifest

START, HOUR = datetime(1969, 12, 30, 7), timedelta(hours=1)
PANEL = "series_id string, ts timestamp_ntz, value double"


def draw(seed):
    """A series with missing hours, null readings and stamps between the hours, straddling the epoch."""
    rng = random.Random(seed)
    n, gaps = rng.randint(1, 120), rng.choice([0.0, 0.03, 0.3])
    series = {}
    for i in range(n):
        if i and rng.random() < gaps:
            continue
        series[START + seed * HOUR + i * HOUR] = None if rng.random() < 0.02 else float(rng.randint(-50, 50))
        if rng.random() < 0.03:
            series[START + seed * HOUR + i * HOUR + timedelta(minutes=rng.randint(1, 59))] = 7.0
    return series


@pytest.fixture(scope="module")
def drawn():
    return {f"s{seed}": draw(seed) for seed in range(25)}


@pytest.fixture(scope="module")
def panel(spark, drawn):
    rows = [(name, ts, value) for name, series in drawn.items() for ts, value in series.items()]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, PANEL)


def gridded(series):
    first = min(series)
    return {ts: v for ts, v in series.items() if (ts - first) % HOUR == timedelta(0)}


def same(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


@pytest.mark.parametrize("steps_per_block", [7, None])
def test_history(panel, drawn, steps_per_block):
    got = lag_features(panel, [1, 5], [3, 40], check=False, steps_per_block=steps_per_block).collect()
    assert len(got) == sum(map(len, drawn.values()))
    for r in got:
        grid = gridded(drawn[r.series_id])
        on = r.ts in grid
        for k in (1, 5):
            assert r[f"lag_{k}h"] == (grid.get(r.ts - k * HOUR) if on else None)
        for w in (3, 40):
            past = [grid.get(r.ts - k * HOUR) for k in range(1, w + 1)]
            whole = on and None not in past
            assert same(r[f"rolling_mean_{w}h"], statistics.fmean(past) if whole else None)
            assert same(r[f"rolling_std_{w}h"], statistics.stdev(past) if whole else None)


@pytest.mark.parametrize("steps_per_block", [7, None])
def test_futures(panel, drawn, steps_per_block):
    got = {(r.series_id, r.ts): r.y for r in horizon_targets(panel, 4, check=False, steps_per_block=steps_per_block).collect()}
    expected = {}
    for name, series in drawn.items():
        grid = gridded(series)
        for ts in grid:
            future = [grid.get(ts + h * HOUR) for h in range(1, 5)]
            if None not in future:
                expected[name, ts] = future
    assert got == expected


@pytest.mark.parametrize("steps_per_block", [7, 16_384])
def test_segments_and_windows(panel, drawn, steps_per_block):
    expected, windows = {}, set()
    for name, series in drawn.items():
        segment, runs, before = 0, [], None
        for ts in sorted(series):
            if before is None or ts - before != HOUR:
                segment += 1
                runs.append([])
            runs[-1].append(ts)
            expected[name, ts] = segment
            before = ts
        windows |= {(name, run[i]) for run in runs for i in range(len(run) - 8)}
    got = {(r.series_id, r.ts): r.segment for r in gap_segments(panel, steps_per_block=steps_per_block).collect()}
    assert got == expected
    manifest = window_manifest(panel, 6, 3, check=False, steps_per_block=steps_per_block)
    assert {(r.series_id, r.start_ts) for r in manifest.collect()} == windows


@pytest.mark.parametrize("steps_per_block", [7, None])
def test_season(panel, drawn, steps_per_block):
    got = seasonal_naive(panel, panel, 3, 10, check=False, steps_per_block=steps_per_block).collect()
    assert len(got) == sum(map(len, drawn.values()))
    for r in got:
        read = [drawn[r.series_id].get(r.ts + (h - 10) * HOUR) for h in range(1, 4)]
        assert r.yhat == (None if None in read else read)


@pytest.mark.parametrize("steps_per_block", [5, 16_384])
def test_splits(panel, drawn, steps_per_block):
    divided = chronological_split(panel, 0.6, 0.3, 0.1, check=False, steps_per_block=steps_per_block)
    got = {(r.series_id, r.ts): (r.split, r.frame_start) for r in divided.collect()}
    expected = {}
    for name, series in drawn.items():
        stamps = sorted(series)
        first, second = int(len(stamps) * 0.6), int(len(stamps) * 0.6) + int(len(stamps) * 0.3)
        for label, part in (("train", stamps[:first]), ("validation", stamps[first:second]), ("test", stamps[second:])):
            expected |= {(name, ts): (label, part[0]) for ts in part}
    assert got == expected
