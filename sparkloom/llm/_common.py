"""What the corpus operators share: the shared folder, written tables, checks of columns."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: the session's spark.checkpoint.dir.

    Where that is unset and Spark runs in one process, as in a test, a new temporary folder is set; with executors
    elsewhere a folder of one machine would lose rows, so that raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(found)
    if "://" not in found and not found.startswith("file:"):
        found = spark._jvm.org.apache.hadoop.fs.Path(found).getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(spark._jvm.org.apache.hadoop.fs.Path(found)).toString()
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"
    _own[path] = spark
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them from there, which cuts the lineage.

    Readers of lost executors' results find the files again; nothing is computed twice. A join with a written
    aggregate has plain exchanges on both sides, which adaptive execution needs to split a hot key.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for path, spark in _own.items():
        try:
            jvm = spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the JVM may have ended first
            return


def local_or_uri(path: str):
    """(filesystem, path) of pyarrow for a path or URI of Hadoop's, for tasks that write bytes."""
    import pyarrow.fs as pf

    if path.startswith("file:"):
        return pf.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return pf.FileSystem.from_uri(path)
    return pf.LocalFileSystem(), path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str):
    """The column of this very name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of df, however capitalised, has."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in held:
            name = "_" + name
        out.append(name)
    return out


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with its columns of these names renamed, and what selects df's columns under their own names again.

    So an operator that adds columns of these names doesn't touch those that the rows came with.
    """
    taken = {n.lower() for n in names}
    own = [c for c in df.columns if c.lower() in taken]
    moved = dict(zip(own, fresh(df, *own), strict=True))
    renamed = df.select(*(col(c).alias(moved.get(c, c)) for c in df.columns))
    return renamed, lambda out: out.select(*(col(moved.get(c, c)).alias(c) for c in df.columns))


def need(df: DataFrame, *columns: str) -> None:
    """Raises ValueError where a column is missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"columns are missing: {missing}; there are {df.columns}")


#: Buckets of the filter below; its broadcast never holds more rows.
FILTER_BUCKETS = 1 << 18


def narrowed(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key falls into a bucket of a wanted key: all that are wanted, and few others while the
    wanted are few. A join on the key follows; this only keeps texts out of its shuffle. What is broadcast is
    bounded by FILTER_BUCKETS whatever the data.
    """
    bucket = F.pmod(F.xxhash64(F.col(key)), F.lit(FILTER_BUCKETS)).cast("int")
    return df.withColumn("_b", bucket).join(F.broadcast(wanted.select(bucket.alias("_b")).distinct()), "_b", "left_semi").drop("_b")
