"""Tables that a job writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only a local master may do without, and gets a temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            return made.get()
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='lumenlake-')}")
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has; it is deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to a new path of the shared folder and read again: what depends on the order of its rows is settled.

    The path is deleted when the session's JVM ends.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    _paths[found] = path
    return found


#: Where tables lie that may be discarded, as long as someone holds them.
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def discard(*tables: DataFrame) -> None:
    """Delete tables made by written() that no result depends on any more."""
    for df in tables:
        if path := _paths.pop(df, None):
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def checked_small(table: DataFrame, most: int) -> DataFrame:
    """table, with a hint to broadcast it if it has at most ``most`` rows; a larger one is joined as Spark sees fit."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table
