"""Files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the session's spark.checkpoint.dir; where that is unset (on one
    machine), in a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = getattr(spark.sparkContext, "_tessera_scratch", None)
        if root is None:
            root = spark.sparkContext._tessera_scratch = tempfile.mkdtemp(prefix="tessera-")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
