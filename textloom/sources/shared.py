"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new path within spark.checkpoint.dir; on a local master without it, within a folder of this run."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and sc._jsc.sc().getCheckpointDir().isDefined():
        named = sc._jsc.sc().getCheckpointDir().get()
    if not named:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="textloom-")
        sc.setCheckpointDir(named)
        named = sc._jsc.sc().getCheckpointDir().get()
    return f"{named.rstrip('/')}/textloom/{sc.applicationId}/{what}-{uuid.uuid4().hex}"
