"""Folders shared by all executors, and tables written there to cut a plan."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_made: list[str] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``.

    Only a session in one local process without that setting falls back to a temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="run-")
    path = f"{base.rstrip('/')}/redactory-{name}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    return path


def forget_written(spark: SparkSession) -> int:
    """Delete all folders that this process has made so far; frames read from them end here.  Gives their number."""
    conf, n = spark._jsc.hadoopConfiguration(), 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        n += path.getFileSystem(conf).delete(path, True)
    return n


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once and read back, for results that several later steps need.

    The table outlives lost executors, and the steps after it do not repeat the
    work before it.
    """
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
