"""Session helpers: UTC clock, checkpoint folder, shared intermediate results."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_shared: list[DataFrame] = []


def use_utc(spark: SparkSession) -> None:
    """All calendar arithmetic (dates, hours, days of month) is in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster in ``spark.checkpoint.dir``.

    A session on one machine (``local[...]``, as in tests) may leave it unset; on
    several machines that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="riskweave-checkpoint-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def at_once(spark: SparkSession, *steps: Callable) -> list:
    """What independent steps return, run side by side: many of their jobs are too short to fill the executors."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]]


def shared(df: DataFrame) -> DataFrame:
    """Mark a result that several branches of one plan read.

    Lazy; partitions lost with an executor are recomputed from lineage, so this
    saves work and never changes a result. ``release_shared`` drops them.
    """
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _shared.append(df)
    return df


def release_shared() -> None:
    while _shared:
        _shared.pop().unpersist()
