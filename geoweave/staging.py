"""Folders that driver and executors share, and tables staged in them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir or the context's checkpoint folder. Where both are unset, a temporary folder in local
    mode; on a cluster, whose machines don't share one, an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="geoweave-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; Spark removes it when the application ends."""
    path = f"{shared_dir(spark)}/geoweave/{name}-{uuid.uuid4().hex}"
    fs, where = file_system(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as its object."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{new_folder(spark, name)}/table"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
