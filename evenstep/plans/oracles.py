"""The same queries in plain SQL, for a side-by-side check over whole tables.

Written from the definitions rather than from the Spark plans: positions by ``row_number``, lags, futures
and seasons by self-joins on the stamp.
"""

from __future__ import annotations

import re

from evenstep.plans.fixtures import HOURLY, LONG, SHORT
from evenstep.plans.preparation import Recipe

_EVENTS_RAW = """
raw AS (SELECT event_type AS series_id, date_trunc('hour', ts)::TIMESTAMP AS ts, round(value * 100) AS value FROM events),
series AS (SELECT series_id, ts, avg(value) AS value FROM raw GROUP BY 1, 2)"""

_DAILY = """
series AS (SELECT 'all' AS series_id, l_shipdate::TIMESTAMP AS ts, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"""

_DAILY_BY_STATUS = """
series AS (SELECT l_returnflag || l_linestatus AS series_id, l_shipdate::TIMESTAMP AS ts, sum(l_quantity) AS value
           FROM lineitem GROUP BY 1, 2)"""

_DIVIDED = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS rn,
                  count(*) OVER (PARTITION BY series_id) AS n FROM series),
divided AS (SELECT series_id, ts, value,
                   CASE WHEN rn < floor(n * 0.7::DOUBLE) THEN 'train'
                        WHEN rn < floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'validation'
                        ELSE 'test' END AS split FROM ranked)"""

_FIXED_DATE = """((month({d}) = 1 AND day({d}) = 1) OR (month({d}) = 6 AND day({d}) = 19 AND year({d}) >= 2021)
  OR (month({d}) = 7 AND day({d}) = 4) OR (month({d}) = 11 AND day({d}) = 11) OR (month({d}) = 12 AND day({d}) = 25))"""


def _is_holiday(day: str) -> str:
    fixed = {k: _FIXED_DATE.format(d=f"({day} + to_days({k}))") for k in (-1, 0, 1)}
    return f"""(
     (isodow({day}) = 1 AND ((month({day}) = 1 AND day({day}) BETWEEN 15 AND 21 AND year({day}) >= 1986)
        OR (month({day}) = 2 AND day({day}) BETWEEN 15 AND 21) OR (month({day}) = 5 AND day({day}) >= 25)
        OR (month({day}) = 9 AND day({day}) <= 7) OR (month({day}) = 10 AND day({day}) BETWEEN 8 AND 14)))
  OR (isodow({day}) = 4 AND month({day}) = 11 AND day({day}) BETWEEN 22 AND 28)
  OR (isodow({day}) <= 5 AND {fixed[0]})
  OR (isodow({day}) = 5 AND {fixed[1]})
  OR (isodow({day}) = 1 AND {fixed[-1]}))"""


def _calendar(start: str) -> str:
    day = "ts::DATE"
    return f"""
    hour(ts)::INTEGER AS hour, (isodow(ts) - 1)::INTEGER AS dayofweek, month(ts)::INTEGER AS month,
    round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos,
    round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) AS dayofweek_sin,
    round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) AS dayofweek_cos,
    round(sin(2 * pi() * (month(ts) - 1) / 12), 6) AS month_sin,
    round(cos(2 * pi() * (month(ts) - 1) / 12), 6) AS month_cos,
    (isodow(ts) >= 6)::INTEGER AS is_weekend,
    ({_is_holiday(day)} AND date_trunc('day', ts) >= {start})::INTEGER AS is_holiday"""


def _unit(recipe: Recipe) -> str:
    return {"h": "HOUR", "D": "DAY"}[recipe.step]


def _history(recipe: Recipe, keys: str, digits: int | None = 6) -> str:
    """Select list of lag and rolling columns."""
    over = f"PARTITION BY {keys} ORDER BY ts RANGE BETWEEN INTERVAL {{0}} {_unit(recipe)} PRECEDING AND INTERVAL {{1}} {_unit(recipe)} PRECEDING"
    out = [f"max(value) OVER ({over.format(k, k)}) AS lag_{k}h" for k in recipe.lags]
    for w in recipe.rolling:
        frame = over.format(w, 1)
        for stat, call in (("mean", "avg"), ("std", "stddev_samp")):
            value = f"{call}(value) OVER ({frame})"
            value = f"round({value}, {digits})" if digits is not None else value
            out.append(f"CASE WHEN count(value) OVER ({frame}) = {w} THEN {value} END AS rolling_{stat}_{w}h")
    return ",\n    ".join(out)


def _features(recipe: Recipe, digits: int | None = 6) -> str:
    """CTEs from ``divided`` to ``features``: rows of each slice whose history is complete."""
    known = " AND ".join(f"{c} IS NOT NULL" for c in ["value", *recipe.history])
    return f"""
lagged AS (SELECT *, min(ts) OVER (PARTITION BY series_id, split) AS frame_start,
    {_history(recipe, "series_id, split", digits)} FROM divided),
features AS (SELECT * FROM lagged WHERE {known})"""


def _targets(recipe: Recipe, rows: str, keys: tuple[str, ...]) -> str:
    """CTE ``targets``: long-form futures of ``rows``, kept where every step is there."""
    same = " AND ".join(f"g.{k} = f.{k}" for k in keys)
    listed = ", ".join(f"f.{k}" for k in keys)
    return f"""
targets AS (SELECT {listed}, f.ts, f.ts + INTERVAL 1 {_unit(recipe)} AS target_ts, h.step::INTEGER AS step, g.value AS value
    FROM {rows} f, (SELECT unnest(range(1, {recipe.horizon} + 1)) AS step) h, {rows} g
    WHERE {same} AND g.ts = f.ts + to_{_unit(recipe).lower()}s(h.step::INTEGER)
    QUALIFY count(*) OVER (PARTITION BY {listed}, f.ts) = {recipe.horizon})"""


def _segments(recipe: Recipe, rows: str, keys: str) -> str:
    return f"""
marked AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY {keys} ORDER BY ts) = INTERVAL 1 {_unit(recipe)}
                          THEN 0 ELSE 1 END AS brk FROM {rows}),
segments AS (SELECT * EXCLUDE (brk), sum(brk) OVER (PARTITION BY {keys} ORDER BY ts)::BIGINT AS segment FROM marked)"""


def _windows(recipe: Recipe, length: int, horizon: int) -> str:
    unit = _unit(recipe)
    return f"""
placed AS (SELECT *, count(*) OVER (PARTITION BY series_id, split, segment ORDER BY ts
                                    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_in_run FROM segments),
windows AS (SELECT series_id, split, ts AS start_ts, ts + INTERVAL {length} {unit} AS target_ts,
                   ts + INTERVAL {length + horizon - 1} {unit} AS end_ts
            FROM placed WHERE left_in_run >= {length + horizon})"""


def _with(*ctes: str) -> str:
    return "WITH " + ",".join(ctes)


def _naive() -> str:
    """CTE ``naive``: test rows with a complete future, the true value and the value one season before."""
    return f"""
naive AS (SELECT t.series_id, t.ts, t.step, t.value AS y, s.value AS yhat
          FROM targets t JOIN series s ON s.series_id = t.series_id
           AND s.ts = t.ts + to_days(t.step) - INTERVAL {LONG.season} DAY
          WHERE t.split = 'test')"""


def _scale_names(recipe: Recipe) -> list[str]:
    return ["value", *recipe.history]


def _stats_long(recipe: Recipe) -> str:
    one = "SELECT series_id, '{c}' AS \"column\", avg({c}) AS mean, stddev_samp({c}) AS std FROM features WHERE split = 'train' GROUP BY 1"
    return "\nstats AS (" + "\nUNION ALL ".join(one.format(c=c) for c in _scale_names(recipe)) + ")"


def _stats_wide(recipe: Recipe) -> str:
    parts = ", ".join(f"avg({c}) AS mean_{c}, stddev_samp({c}) AS std_{c}" for c in _scale_names(recipe))
    return f"\nstats AS (SELECT series_id, {parts} FROM features WHERE split = 'train' GROUP BY 1)"


def _null_columns() -> str:
    parts = [f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS null_rows FROM lagged" for c in ["value", *SHORT.history]]
    return " UNION ALL ".join(parts)


def _constant_columns() -> str:
    calendar = ["hour", "dayofweek", "month", "hour_sin", "hour_cos", "dayofweek_sin", "dayofweek_cos", "month_sin",
                "month_cos", "is_weekend", "is_holiday"]
    one = "SELECT series_id, '{c}' AS \"column\" FROM wide WHERE split = 'train' GROUP BY 1 HAVING count(*) > 1 AND min({c}) = max({c})"
    return " UNION ALL ".join(one.format(c=c) for c in ["value", *calendar, *LONG.history])


def _sequence_sums(recipe: Recipe) -> str:
    step = "(date_diff('day', w.start_ts, f.ts) + 1)"
    ahead = "f.ts >= w.target_ts"

    def one(name: str, column: str, part: str) -> str:
        return f"""SELECT series_id, split, start_ts, target_ts, '{name}' AS "column", count(*) FILTER ({part}) AS "values",
            round(sum({column} * step) FILTER ({part}), 3) + 0.0 AS weighed FROM met GROUP BY ALL"""

    met = f"""SELECT w.*, f.* EXCLUDE (series_id, split, ts), {step} AS step, {ahead} AS ahead
        FROM windows w JOIN wide f ON f.series_id = w.series_id AND f.split = w.split AND f.ts BETWEEN w.start_ts AND w.end_ts"""
    parts = [one(name, name, "NOT ahead") for name in recipe.features] + [one("y", "value", "ahead")]
    wide = f"SELECT series_id, split, ts, value, {_calendar_exact('frame_start')}, {', '.join(recipe.history)} FROM features"
    return f", wide AS ({wide}), met AS MATERIALIZED ({met}) " + " UNION ALL ".join(parts)


def _calendar_exact(start: str) -> str:
    return re.sub(r"round\((.*?), 6\) AS", r"\1 AS", _calendar(start))


def _one_lag() -> str:
    """CTEs: supervised rows with the lag, and a line per step fitted to the training rows."""
    return """
rows_of AS (SELECT t.series_id, t.split, t.ts, t.step, t.value AS y, f.lag_1h FROM targets t JOIN features f USING (series_id, split, ts)),
line AS (SELECT step, regr_slope(y, lag_1h) AS b, regr_intercept(y, lag_1h) AS a FROM rows_of WHERE split = 'train' GROUP BY 1)"""


_SHORT_FEATURES = (_DAILY_BY_STATUS, _DIVIDED, _features(SHORT))
_LONG_FEATURES = (_DAILY, _DIVIDED, _features(LONG, digits=None))
_SUPERVISED = (_DAILY, _DIVIDED, _features(SHORT, digits=None), _targets(SHORT, "features", ("series_id", "split")))
_ONE_LAG_FORECAST = (
    _with(*_SUPERVISED, _one_lag())
    + " SELECT series_id, ts, step, round(a + b * lag_1h, 2) AS yhat FROM rows_of JOIN line USING (step) WHERE split = 'test'"
)


def _best_split(name: str, rows: str) -> str:
    """CTEs ``<name>_best`` (the split of ``y`` on one feature that lowers the variance most) and ``<name>``, each row's leaf."""
    return f"""
{name}_long AS (UNPIVOT (SELECT dayofweek, month, y FROM {rows} WHERE split = 'train') ON dayofweek, month INTO NAME feature VALUE x),
{name}_values AS (SELECT feature, x, count(*) AS n, sum(y) AS s FROM {name}_long GROUP BY 1, 2),
{name}_cuts AS (SELECT feature, x, lead(x) OVER w AS above, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER (PARTITION BY feature) AS n,
                       sum(s) OVER (PARTITION BY feature) AS s FROM {name}_values WINDOW w AS (PARTITION BY feature ORDER BY x)),
{name}_best AS (SELECT feature, (x + above) / 2 AS cut_at, sl / nl AS low, (s - sl) / (n - nl) AS high FROM {name}_cuts WHERE above IS NOT NULL
                ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC LIMIT 1),
{name} AS (SELECT ts, CASE WHEN CASE feature WHEN 'month' THEN month ELSE dayofweek END <= cut_at THEN low ELSE high END AS leaf
           FROM {rows}, {name}_best)"""


_STUMPS = (
    _with(
        *_SUPERVISED,
        """
rows_of AS (SELECT split, ts, (isodow(ts) - 1)::DOUBLE AS dayofweek, month(ts)::DOUBLE AS month, value AS y FROM targets WHERE step = 1)""",
        _best_split("first", "rows_of"),
        """
left_over AS (SELECT r.* REPLACE (r.y - first.leaf AS y) FROM rows_of r JOIN first USING (ts))""",
        _best_split("second", "left_over"),
    )
    + """ SELECT 'all' AS series_id, r.ts, 1::INTEGER AS step, round({yhat}, 2) AS yhat
         FROM rows_of r JOIN first USING (ts) JOIN second USING (ts) WHERE split = 'test'"""
)
_SEGMENTED = (*_SHORT_FEATURES, _segments(SHORT, "features", "series_id, split"))
_NAIVE = (*_LONG_FEATURES, _targets(LONG, "features", ("series_id", "split")), _naive())

_REPORT = """
SELECT series_id, rows, missing_target_ratio, missing_index_ratio,
       ((rows < 1000)::INTEGER + (missing_target_ratio > 0.01::DOUBLE)::INTEGER + (missing_index_ratio > 0.01::DOUBLE)::INTEGER) AS problem_count
FROM (SELECT series_id, count(*) AS rows, avg((value IS NULL)::INTEGER) AS missing_target_ratio,
             ((date_diff('{unit}', min(ts), max(ts)) + 1) - count(*))::DOUBLE / (date_diff('{unit}', min(ts), max(ts)) + 1)
                 AS missing_index_ratio
      FROM {rows} GROUP BY 1)"""

ORACLES: dict[str, str] = {
    "observations": "SELECT event_type AS series_id, ts::TIMESTAMP AS ts, value FROM events",
    "clean_hourly": _with(_EVENTS_RAW) + " SELECT series_id, ts, value FROM series",
    "clean_audit": _with(_EVENTS_RAW)
    + """ SELECT series_id, count(*) AS rows_in, count(DISTINCT ts) AS rows_out,
          count(ts) - count(DISTINCT ts) AS duplicates_averaged, count(*) - count(ts) AS null_stamps
          FROM raw GROUP BY 1""",
    "duplicate_stamps": _with(_EVENTS_RAW)
    + " SELECT series_id, count(ts) - count(DISTINCT ts) AS duplicates FROM raw GROUP BY 1",
    "complete_grid": _with(_EVENTS_RAW)
    + """, grid AS (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM series GROUP BY 1)
       SELECT g.series_id, g.ts, s.value FROM grid g LEFT JOIN series s ON s.series_id = g.series_id AND s.ts = g.ts""",
    "missing_stamps": _with(_EVENTS_RAW)
    + """, grid AS (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM series GROUP BY 1)
       SELECT g.series_id, g.ts FROM grid g
       WHERE NOT EXISTS (SELECT 1 FROM series s WHERE s.series_id = g.series_id AND s.ts = g.ts)""",
    "arrival_disorder": """
       SELECT series_id, count(*) AS rows, count(*) FILTER (WHERE l_shipdate < seen) AS late_rows, 0::BIGINT AS unnumbered_rows
       FROM (SELECT l_suppkey::VARCHAR AS series_id, l_shipdate,
                    max(l_shipdate) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_shipdate
                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM lineitem)
       GROUP BY 1""",
    "validation_report": _with(_EVENTS_RAW.replace("series AS", "hourly AS"), _DAILY_BY_STATUS.replace("series AS", "daily AS"))
    + _REPORT.format(unit="hour", rows="hourly") + " UNION ALL " + _REPORT.format(unit="day", rows="daily"),
    "chronological_split": _with(_DAILY_BY_STATUS, _DIVIDED) + " SELECT series_id, split, ts, value FROM divided",
    "split_summary": _with(_DAILY_BY_STATUS, _DIVIDED)
    + " SELECT series_id, split, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM divided GROUP BY 1, 2",
    "split_union": _with(_DAILY_BY_STATUS) + " SELECT series_id, ts, value FROM series",
    "calendar_features": _with(_EVENTS_RAW.replace("series AS", "hourly AS"), _DAILY.replace("series AS", "daily AS"))
    + f""", stamps AS (SELECT series_id, ts FROM hourly UNION ALL SELECT series_id, ts FROM daily),
       started AS (SELECT *, min(ts) OVER (PARTITION BY series_id) AS frame_start FROM stamps)
       SELECT series_id, ts, {_calendar("frame_start")} FROM started""",
    "holiday_dates": _with(_DAILY)
    + f""", span AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM series GROUP BY 1),
       days AS (SELECT series_id, lo, unnest(generate_series(date_trunc('day', lo)::TIMESTAMP, hi, INTERVAL 1 DAY)) AS d FROM span)
       SELECT series_id, d::DATE::VARCHAR AS holiday FROM days WHERE {_is_holiday("d::DATE")} AND d >= lo""",
    "lag_features": _with(_EVENTS_RAW)
    + " SELECT s.series_id, s.ts, s.value, "
    + ", ".join(f"p{k}.value AS lag_{k}h" for k in HOURLY.lags)
    + " FROM series s "
    + " ".join(
        f"LEFT JOIN series p{k} ON p{k}.series_id = s.series_id AND p{k}.ts = s.ts - INTERVAL {k} HOUR" for k in HOURLY.lags
    ),
    "lag_disagreement": _with(_EVENTS_RAW)
    + """, both_ways AS (SELECT s.series_id, lag(s.value, 3) OVER (PARTITION BY s.series_id ORDER BY s.ts) AS by_row, p.value AS by_time
         FROM series s LEFT JOIN series p ON p.series_id = s.series_id AND p.ts = s.ts - INTERVAL 3 HOUR)
       SELECT series_id, count(*) AS rows, count(*) FILTER (WHERE by_row <> by_time) AS disagreeing_rows FROM both_ways GROUP BY 1""",
    "rolling_features": _with(_EVENTS_RAW)
    + f" SELECT series_id, ts, {_history(Recipe(step='h', lags=(), rolling=HOURLY.rolling, horizon=3, season=12), 'series_id')} FROM series",
    "feature_audit": _with(_EVENTS_RAW)
    + f""", lagged AS (SELECT *, min(ts) OVER (PARTITION BY series_id) AS frame_start, {_history(HOURLY, "series_id")} FROM series)
       SELECT series_id, count(*) AS rows,
              count(*) FILTER (WHERE {_is_holiday("ts::DATE")} AND date_trunc('day', ts) >= frame_start) AS holiday_rows,
              count(*) FILTER (WHERE {" OR ".join(f"{c} IS NULL" for c in HOURLY.history)}) AS incomplete_rows
       FROM lagged GROUP BY 1""",
    "feature_frame": _with(*_SHORT_FEATURES)
    + f" SELECT series_id, split, ts, value, {_calendar('frame_start')}, {', '.join(SHORT.history)} FROM features",
    "null_columns": _with(*_SHORT_FEATURES) + " " + _null_columns(),
    "horizon_targets": _with(*_SHORT_FEATURES, _targets(SHORT, "features", ("series_id", "split")))
    + " SELECT series_id, split, ts, target_ts, step, value FROM targets",
    "horizon_targets_of_series": _with(_DAILY_BY_STATUS, _targets(SHORT, "series", ("series_id",)))
    + " SELECT series_id, ts, target_ts, step, value FROM targets",
    "gap_segments": _with(_DAILY_BY_STATUS, _segments(SHORT, "series", "series_id"))
    + " SELECT series_id, ts, segment FROM segments",
    "segment_lengths": _with(_DAILY_BY_STATUS, _segments(SHORT, "series", "series_id"))
    + f""" SELECT series_id, segment, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts,
          greatest(count(*) - {SHORT.sequence_length + SHORT.horizon - 1}, 0)::BIGINT AS windows,
          count(*) < {SHORT.sequence_length + SHORT.horizon} AS too_short FROM segments GROUP BY 1, 2""",
    "window_manifest": _with(*_SEGMENTED, _windows(SHORT, SHORT.sequence_length, SHORT.horizon))
    + " SELECT series_id, split, start_ts, target_ts, end_ts FROM windows",
    "sequence_windows": _with(_DAILY_BY_STATUS, _DIVIDED, _features(SHORT, digits=None), _segments(SHORT, "features", "series_id, split"), _windows(SHORT, SHORT.sequence_length, SHORT.horizon))
    + _sequence_sums(SHORT),
    "stored_windows": _with(*_LONG_FEATURES, _segments(LONG, "features", "series_id, split"), _windows(LONG, LONG.sequence_length, LONG.horizon))
    + _sequence_sums(LONG),
    "tail_holdout": _with(*_SEGMENTED, _windows(SHORT, SHORT.sequence_length, SHORT.horizon))
    + """ SELECT series_id, split, target_ts,
          CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY target_ts) - 1
                    < floor(count(*) OVER (PARTITION BY series_id) * (1.0::DOUBLE - 0.1::DOUBLE)) THEN 'fit' ELSE 'holdout' END AS part
          FROM windows WHERE split = 'train'""",
    "dataset_sizes": _with(
        *_SEGMENTED,
        _windows(SHORT, SHORT.sequence_length, SHORT.horizon),
        _targets(SHORT, "features", ("series_id", "split")),
    )
    + f""", sizes AS (SELECT series_id, split, 'rows' AS what FROM features
         UNION ALL SELECT series_id, split, 'target_rows' FROM targets WHERE step = 1
         UNION ALL SELECT series_id, split, 'windows' FROM windows)
       SELECT series_id, split, count(*) FILTER (WHERE what = 'rows') AS rows,
              count(*) FILTER (WHERE what = 'target_rows') AS target_rows,
              count(*) FILTER (WHERE what = 'windows') AS windows, {len(SHORT.features)}::INTEGER AS n_features
       FROM sizes GROUP BY 1, 2""",
    "scaler_fit": _with(*_LONG_FEATURES, _stats_long(LONG))
    + " SELECT series_id, \"column\", round(mean, 6) AS mean, round(std, 6) AS std FROM stats",
    "constant_columns": _with(*_LONG_FEATURES)
    + f", wide AS (SELECT *, {_calendar('frame_start')} FROM features) " + _constant_columns(),
    "scaled_features": _with(*_LONG_FEATURES, _stats_wide(LONG))
    + " SELECT f.series_id, f.split, f.ts, hour(f.ts)::INTEGER AS hour, (isodow(f.ts) - 1)::INTEGER AS dayofweek, "
    + ", ".join(f"round((f.{c} - s.mean_{c}) / s.std_{c}, 6) AS {c}" for c in _scale_names(LONG))
    + " FROM features f JOIN stats s USING (series_id)",
    "inverse_scaled": _with(*_LONG_FEATURES, _targets(LONG, "features", ("series_id", "split")))
    + " SELECT series_id, split, ts, step, round(value, 6) AS value FROM targets",
    "split_drift": _with(*_LONG_FEATURES, _stats_wide(LONG))
    + """ SELECT f.series_id, f.split, round(avg((f.value - s.mean_value) / s.std_value), 6) AS mean_scaled
          FROM features f JOIN stats s USING (series_id) GROUP BY 1, 2""",
    "seasonal_naive": _with(*_NAIVE) + " SELECT series_id, ts, step, yhat FROM naive",
    "naive_rmse": _with(*_NAIVE)
    + " SELECT series_id, count(*) AS n, 0::BIGINT AS unscored, round(sqrt(sum((yhat - y) * (yhat - y)) / count(*)), 6) AS rmse FROM naive GROUP BY 1",
    "rmse_by_step": _with(*_NAIVE)
    + """ SELECT series_id, step, count(*) AS n, round(sqrt(sum((yhat - y) * (yhat - y)) / count(*)), 6) AS rmse
          FROM naive GROUP BY 1, 2""",
    "linear_one_lag": _ONE_LAG_FORECAST,
    "linear_two_features": _with(*_LONG_FEATURES, _targets(LONG, "features", ("series_id", "split")))
    + """, rows_of AS (SELECT t.series_id, t.split, t.ts, t.step, t.value AS y, f.lag_24h AS a, f.rolling_mean_24h AS b
                       FROM targets t JOIN features f USING (series_id, split, ts)),
       moments AS (SELECT step, avg(a) AS ma, avg(b) AS mb, avg(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab,
                          covar_pop(a, y) AS ay, covar_pop(b, y) AS yb FROM rows_of WHERE split = 'train' GROUP BY 1),
       plane AS (SELECT *, (ay * bb - yb * ab) / (aa * bb - ab * ab) AS wa, (yb * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM moments)
       SELECT series_id, ts, step, round(my + wa * (a - ma) + wb * (b - mb), 2) AS yhat
       FROM rows_of JOIN plane USING (step) WHERE split = 'test'""",
    "prepared_counts": _with(_DAILY, _DIVIDED, _features(SHORT, digits=None), _targets(SHORT, "features", ("series_id", "split")),
                             _segments(SHORT, "features", "series_id, split"), _windows(SHORT, SHORT.sequence_length, SHORT.horizon))
    + f""", flagged AS (SELECT split, {_is_holiday("ts::DATE")} AND date_trunc('day', ts) >= frame_start AS holiday,
                               {" OR ".join(f"{c} IS NULL" for c in SHORT.history)} AS incomplete FROM lagged),
       cells AS (SELECT split, 1 AS row, holiday::INTEGER AS holiday, incomplete::INTEGER AS incomplete, 0 AS feature, 0 AS target, 0 AS windowed FROM flagged
         UNION ALL SELECT split, 0, 0, 0, 1, 0, 0 FROM features UNION ALL SELECT split, 0, 0, 0, 0, 1, 0 FROM targets WHERE step = 1
         UNION ALL SELECT split, 0, 0, 0, 0, 0, 1 FROM windows)
       SELECT split, sum(row)::BIGINT AS rows, sum(holiday)::BIGINT AS holiday_rows, sum(incomplete)::BIGINT AS incomplete_rows,
              sum(feature)::BIGINT AS feature_rows, sum(target)::BIGINT AS target_rows, sum(windowed)::BIGINT AS windows FROM cells GROUP BY 1""",
    "scaled_register_reload": _ONE_LAG_FORECAST,
    "linear_normal_equations": f"""SELECT step::INTEGER AS step, feature, 0.0::DOUBLE AS moment
       FROM range(1, {SHORT.horizon + 1}) t(step), (SELECT unnest({SHORT.features}) AS feature)""",
    "forest_stump": _STUMPS.format(yhat="first.leaf"),
    "trees_register_reload": _STUMPS.format(yhat="first.leaf"),
    "boosted_stumps": _STUMPS.format(yhat="first.leaf + second.leaf"),
    "leaderboard_naive_linear": _with(*_SUPERVISED, _one_lag())
    + f""", both_ways AS (
         SELECT r.y, r.ts, s.value AS naive, a + b * lag_1h AS linear FROM rows_of r JOIN line USING (step)
         JOIN series s ON s.ts = r.ts + to_days(r.step) - INTERVAL {SHORT.season} DAY WHERE split = 'test'),
       scores AS (UNPIVOT (SELECT count(*) AS n, sqrt(avg((naive - y) ** 2)) AS naive, sqrt(avg((linear - y) ** 2)) AS linear FROM both_ways)
                  ON naive, linear INTO NAME model VALUE rmse)
       SELECT model, n, 0::BIGINT AS unscored, round(rmse, 2) AS rmse,
              round((1 - rmse / max(rmse) FILTER (model = 'naive') OVER ()) * 100)::INTEGER AS improvement_pct FROM scores""",
    "csv_roundtrip": "SELECT event_type AS series_id, ts::TIMESTAMP AS ts, value FROM events",
    "csv_two_headers": "SELECT event_type AS series_id, ts::TIMESTAMP AS ts, value FROM events",
    "latest_version": """SELECT o_orderpriority AS name, max(o_orderkey)::VARCHAR AS version FROM orders GROUP BY 1""",
}
