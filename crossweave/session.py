"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target


def local_session(cores: str = "*", name: str = "crossweave") -> SparkSession:
    """A session for tests and laptops; on a cluster, pass the cluster's own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CROSSWEAVE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local master may go without that setting; a cluster must name a
    folder every executor reaches.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    made = os.environ.get("CROSSWEAVE_SCRATCH")
    if not made:
        made = tempfile.mkdtemp(prefix="crossweave-")
        os.environ["CROSSWEAVE_SCRATCH"] = made
    return made


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    Cuts the lineage where several branches or rounds reuse a result. A written
    table survives lost executors, keeps column pruning for its readers, and
    gives the planner true sizes to choose joins by.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/crossweave/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def beside(spark: SparkSession, work: Callable) -> Iterator[Future]:
    """Does ``work()`` while the block runs; its jobs fill cores that the block's leave free.

    The block's end waits for it, and a failure of it is raised by ``result()``, which the block must ask.
    """
    with ThreadPoolExecutor(1) as thread:
        yield thread.submit(inheritable_thread_target(spark)(work))


def spread(df: DataFrame) -> DataFrame:
    """More partitions for costly per-row work, where the input has fewer than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt over all cores for costly work per row.

    A given number of partitions stays: few bytes may be much work, and would else end in one task.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
