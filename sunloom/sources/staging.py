"""Intermediate results in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share.

    Where none is set, a session in local mode gets one of its own; on a cluster this raises, as a driver's disk is not shared.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """A copy of df in the checkpoint folder: lineage ends there, and lost executors cost no recomputation."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints for a table that no result outlives; it goes when the application ends, or by remove()."""
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    # marked once it is there: a path that does not exist cannot be marked
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(target)
    store.deleteOnExit(target)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a compressed table in a scratch folder, for a result that reads it more than once."""
    path = f"{scratch(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever file system it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
