"""Shapes of plans: what is shuffled, and which side of a join is sent."""

from __future__ import annotations

import contextlib
import io
import re

from evenstep.operators.lags import lag_disagreement, number_rows
from evenstep.operators.splitting import chronological_split
from evenstep.operators.windows import gap_segments
from evenstep.plans.preparation import Recipe, divide, feature_frame, stored_blocks, supervised_frame

HOUR = 3_600_000_000


def _plan(frame) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        frame.explain()
    return out.getvalue()


def _shuffles(frame) -> int:
    return len(re.findall(r"\bExchange hashpartitioning", _plan(frame)))


def test_rows_are_shuffled_once_to_be_numbered(ramp):
    assert _shuffles(number_rows(ramp(50), HOUR)) <= 2


def test_segments_are_answered_from_stored_marks(ramp):
    assert _shuffles(gap_segments(ramp(50, drop=(7,)))) <= 2


def test_lag_disagreement_has_few_wide_shuffles(ramp):
    assert _shuffles(lag_disagreement(ramp(50), 2)) <= 5


def test_a_split_sends_the_bounds_not_the_series(ramp):
    plan = _plan(chronological_split(ramp(200)))
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "Exchange hashpartitioning" not in plan


def test_stored_blocks_need_no_further_shuffle(ramp):
    recipe = Recipe(lags=(1, 2, 24), rolling=(6, 24), sequence_length=24, horizon=4, season=24)
    divided = divide(ramp(900, drop=(100,)).unionByName(ramp(700, series="b")), recipe)
    blocks = stored_blocks(divided, recipe)
    for build in (feature_frame, supervised_frame):
        frame = build(divided, recipe, blocks)
        assert "Exchange" not in _plan(frame) and "Window" in _plan(frame)
        key = lambda f: sorted(map(str, f.drop("frame_start").collect()))
        assert key(frame) == key(build(divided, recipe))
