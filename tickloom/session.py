"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

#: Intermediates of a local session that names no folder; a cluster sets spark.checkpoint.dir.
LOCAL_SCRATCH = os.environ.get("TICKLOOM_SCRATCH", "/tmp/tickloom-scratch")


def build_session(name: str = "tickloom", cores: str | None = None) -> SparkSession:
    """Local session for tests and the bench; a cluster passes its own session instead."""
    n = cores or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TICKLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", n)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach; the cluster names it in spark.checkpoint.dir."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[[^]]*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return f"{LOCAL_SCRATCH}/{spark.sparkContext.applicationId}"  # one process: driver and tasks share its disk


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: iterative jobs restart from files, not from lost executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
