"""Where tables of a job go: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; in a folder of our own only where that is unset and all of Spark runs
    in this process, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = spark.sparkContext.getCheckpointDir()
        if not at:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
            at = spark.sparkContext.getCheckpointDir()
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"
