"""Session defaults and the one place that cuts lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app: str = "rosterforge", master: str | None = None,
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution, skew-join handling and UTC time."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            builder = builder.config("spark.driver.memory", os.environ.get("ROSTERFORGE_DRIVER_MEMORY", "12g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt by ``columns`` over all shuffle partitions, before a step that makes many rows of one.

    A number that is asked for is kept by adaptive execution, so one scan task or one merged
    partition does not do that step for a whole table.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def dealt_by_rows(df: DataFrame, rows: int, share: int, *columns: str) -> DataFrame:
    """``rows`` rows dealt by ``columns`` in partitions of about ``share``, before a step that holds all of a partition.

    Adaptive execution merges partitions by their compressed size, which says little about nested rows in memory.
    There are at least as many as a shuffle has, since a join would deal fewer ones anew.
    """
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // share)), *columns)


def durable_checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and forget its lineage.

    The folder comes from the session; see ``shared_base``.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_base(spark: SparkSession) -> str:
    """The folder that the session names for data all executors read.

    A local session without one gets a private folder, once; on a cluster its absence is an error.
    """
    base = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="rosterforge-")
        spark.conf.set(CHECKPOINT_CONF, base)
    return base.rstrip("/")


def staging_dir(spark: SparkSession, name: str) -> str:
    """A fresh shared folder for tables a job writes and reads back."""
    return f"{shared_base(spark)}/{name}-{uuid.uuid4().hex}"


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that tasks open by themselves, and its path there."""
    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
