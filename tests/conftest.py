from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])  # for Spark's workers

PANEL = "series_id string, ts timestamp_ntz, value double"
START = datetime(2020, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("evenstep-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def ramp(spark):
    """Hourly ``value = i``, with chosen positions left out or set to null."""

    def build(n, drop=(), null=(), series="all", start=START, step=timedelta(hours=1)):
        rows = [(series, start + i * step, None if i in null else float(i)) for i in range(n) if i not in drop]
        return spark.createDataFrame(rows, PANEL)

    return build
