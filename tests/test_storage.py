"""Storage between steps, in sessions of their own: with nothing preset, and with the folder cleared after a run."""

import os
import subprocess
import sys
from pathlib import Path

from evenstep.sources.storage import run_storage, settle, settle_alone, shared_folder

ROOT = Path(__file__).resolve().parents[1]

BARE_SESSION = """
from pyspark.sql import SparkSession
from evenstep.sources.storage import STORAGE, settle
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert settle(spark.range(7)).count() == 7
assert settle(spark.range(3)).count() == 3
print("folder", spark.conf.get(STORAGE))
"""


def test_session_without_any_setting_settles(tmp_path):
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(ROOT)}
    done = subprocess.run([sys.executable, "-c", BARE_SESSION], env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "folder /" in done.stdout


def test_run_storage_leaves_nothing(spark):
    with run_storage(spark) as folder:
        assert settle(spark.range(5)).count() == 5
        assert any(Path(folder).glob("settled-*"))
    assert not Path(folder).exists()


def test_a_result_outlives_what_it_was_made_of(spark):
    before = set(Path(shared_folder(spark).removeprefix("file:")).iterdir())
    made = settle_alone(spark, lambda: settle(spark.range(5)).unionByName(settle(spark.range(2))))
    assert made.count() == 7
    left = [p for p in set(Path(shared_folder(spark).removeprefix("file:")).iterdir()) - before if any(p.iterdir())]
    assert len(left) == 1 and left[0].name.startswith("settled-")
