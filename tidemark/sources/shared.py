"""The folder that driver and executors share, and files in it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in spark.checkpoint.dir; where that is unset and Spark runs on one machine, in a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    return f"{found.rstrip('/')}/tidemark/{what}-{uuid.uuid4().hex}"


def write_texts(df: DataFrame, what: str) -> str:
    """A file for each row of df, which has one column of text; gives the folder."""
    path = shared_path(df.sparkSession, what)
    df.write.option("maxRecordsPerFile", 1).text(path)
    return path


def write_bytes(spark: SparkSession, what: str, data: bytes) -> str:
    """One file of a bounded size, through Hadoop's file systems; gives its path."""
    path = shared_path(spark, what)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path
