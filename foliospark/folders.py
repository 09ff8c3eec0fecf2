"""Folders that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, or under a temporary one where all run in one process (tests)."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        import tempfile

        top = tempfile.mkdtemp(prefix="foliospark-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/foliospark/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
