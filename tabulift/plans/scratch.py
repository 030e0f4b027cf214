"""Shared storage for intermediate results that must survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; only a local session may fall back to a temporary one."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tabulift-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and continue from there, so that their order and split are fixed."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def held(df: DataFrame, wanted: bool = True):
    """Keep a table in executor memory and disk inside the block, if wanted: for tables that are read several times."""
    if not wanted:
        yield df
        return
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer splits than there are cores, spread over them; larger scans stay as they are.

    Meant for plain scans (the number of splits of a shuffled table is not known before it runs) of small files that
    several passes will read.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def dealt(df: DataFrame, rows: int, most: int) -> DataFrame:
    """A table of so many rows spread over all cores, and over so many tasks that none gets more than about ``most`` rows."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // most)))
