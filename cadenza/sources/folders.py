"""Folders that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def shared(spark: SparkSession, name: str) -> str:
    """A new folder's path below the session's checkpoint folder. A session that names none is refused, since a folder of the
    driver's own can't be read by executors, unless all of it runs on one machine."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if base is None and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if base is None:
        import tempfile

        base = tempfile.mkdtemp(prefix="cadenza-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
