"""Paths in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_made: dict[str, SparkSession] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under the session's spark.checkpoint.dir, deleted when the driver's Python ends.

    Where that is unset, a session in one process gets a temporary folder; others raise.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sparkloom-files-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/sparkloom-files/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


@atexit.register
def _clean() -> None:
    for path, spark in _made.items():
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may have ended first
            return


def written(df, name: str):
    """The rows, written to the shared folder once and read from there: what several branches of a plan use."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
