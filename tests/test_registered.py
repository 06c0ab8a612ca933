"""Every registered query over whole tables: against its SQL where there is one, else by its shape."""

import math

import pytest
from compare import TABLES, connect, differences

import __spark_entry__ as driver

SF = "sf0.01"


@pytest.fixture(scope="module")
def tables():
    if not (TABLES / SF).exists():
        pytest.skip("no driver tables here")
    return connect(SF)


@pytest.mark.parametrize("name", sorted(set(driver.oracle_sql()) - set(driver.LLM_ORACLES)))
def test_query_equals_its_sql(spark, tables, name):
    got = driver.queries()[name](spark, str(TABLES / SF)).toPandas()
    assert differences(got, tables.execute(driver.oracle_sql()[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(driver.queries()) - set(driver.LLM_QUERIES) - set(driver.oracle_sql())))
def test_fitted_forecasts_are_finite(spark, tables, name):
    got = driver.queries()[name](spark, str(TABLES / SF)).toPandas()
    numbers = got["rmse" if name == "forecast_leaderboard" else "yhat"]
    assert len(got) and all(math.isfinite(v) for v in numbers)


def test_entry_has_an_error_for_each_step(spark, tables):
    rows = driver.entry(spark).collect()
    assert sorted(r.step for r in rows) == list(range(1, 8)) and all(r.rmse > 0 for r in rows)
