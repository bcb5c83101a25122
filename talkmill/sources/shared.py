"""The folder that driver and executors share, and tables written there."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Only where none is set and driver and executors are
    one process, as in tests, a temporary one takes its place; on a cluster that would part them, so it is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        sc = spark.sparkContext
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _local_dirs.setdefault(sc.applicationId, "") or tempfile.mkdtemp(prefix="talkmill-")
        _local_dirs[sc.applicationId] = path
    return path.rstrip("/")


def own_folder(spark: SparkSession, name: str) -> str:
    """A folder in the shared one that nobody else writes to."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the store that Hadoop finds it in, the same for Spark and for Python workers."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def stored(spark: SparkSession, df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows written to the shared folder and read again: lineage ends here, and a lost executor costs nothing."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a folder that ``stored`` wrote, once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a folder's files."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()
