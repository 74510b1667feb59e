"""Folders that all machines share, and cutting lineage by tables written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Where it names none: a folder of this machine if Spark runs on this machine alone, else one
    in Hadoop's default file system, unless that is a machine's own disk, which is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        folder = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
    else:
        hadoop = spark.sparkContext._jsc.hadoopConfiguration()
        files = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem.get(hadoop)
        if files.getUri().getScheme() == "file":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = f"{files.getHomeDirectory().toString()}/spark-shared"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def shared_folder(spark: SparkSession, prefix: str = "veilframe") -> str:
    """The name of a new folder below the shared root."""
    return f"{shared_root(spark)}/{prefix}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Later reads are columnar, take only the columns they need, and outlive lost executors.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, path: str) -> bool:
    """Whether there is anything under a path, in whatever file system it names."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
