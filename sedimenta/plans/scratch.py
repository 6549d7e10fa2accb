"""A folder for written tables that every executor sees."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a folder of its own; on a cluster it is an error, as a
    machine's own folder is not shared.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="sedimenta-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sedimenta-{spark.conf.get('spark.app.id', 'session')}"


def path(spark: SparkSession, tag: str) -> str:
    """A new path in that folder."""
    return f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"


def clean(spark: SparkSession) -> None:
    """Delete what this application has written there; results that are still lazy need it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder(spark))
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
