"""Cutting a long plan at a table in shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: This library's own setting; may be set at run time, unlike the cluster's.
STORAGE = "spark.evenstep.storage"
CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Where tables between steps go: ``spark.evenstep.storage``, else the cluster's checkpoint folder.

    A folder that was named is trusted to be shared, whatever its scheme (a mounted share is a ``file:`` path).
    Where neither is named, a local session gets a temporary folder, kept in the session's own setting; a
    cluster has no default, since a machine-local folder would vanish with its executor.
    """
    folder = spark.conf.get(STORAGE, None) or spark.conf.get(CHECKPOINT_DIR, None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {STORAGE} or {CHECKPOINT_DIR} to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="evenstep-")
    spark.conf.set(STORAGE, folder)
    return folder


def settle_bucketed(df: DataFrame, columns: list[str], buckets: int | None = None) -> DataFrame:
    """Write ``df`` once in buckets of ``columns`` and go on from them: what groups by these columns, or by more than these,
    needs no shuffle, however often the table is read. A bucket is a file, written by one task; their number is that of the
    session's shuffle partitions unless given.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"evenstep_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *columns).write.bucketBy(buckets, *columns)
    dealt.option("path", f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}").saveAsTable(name, format="parquet")
    return spark.table(name)


@contextmanager
def run_storage(spark: SparkSession) -> Iterator[str]:
    """A folder for one run: every table settled inside the block is deleted when the block ends.

    Frames that read such tables must be written or counted before the end.
    """
    before = spark.conf.get(STORAGE, None)
    folder = f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"
    spark.conf.set(STORAGE, folder)
    try:
        yield folder
    finally:
        spark.conf.unset(STORAGE) if before is None else spark.conf.set(STORAGE, before)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once and go on from the files.

    Used where one result feeds several passes. Unlike a cached block, the table survives lost executors,
    and unlike a checkpointed RDD it keeps column pruning, filter pushdown and size statistics.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_alone(spark: SparkSession, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` returns, written once; the tables that were settled on the way there are deleted."""
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    with run_storage(spark):
        built = build()
        built.write.parquet(path)
    return spark.read.schema(built.schema).parquet(path)
