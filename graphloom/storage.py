"""Where intermediate tables and checkpoints go: the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_base(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, set as its checkpoint folder.

    Where it is unset, local mode gets a folder of this machine; on a cluster that would lose data, so it is an error."""
    context = spark.sparkContext
    got = context._jsc.sc().getCheckpointDir()
    base = spark.conf.get("spark.checkpoint.dir", None) or (got.get() if got.isDefined() else None)
    if not base:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    if not got.isDefined():
        context.setCheckpointDir(base)
    return base.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path in any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
