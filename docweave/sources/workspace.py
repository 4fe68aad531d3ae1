"""A folder that the driver and all executors share, for tables and stream checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def workspace(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; only a local session may use a temporary folder instead."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        app = spark.sparkContext.applicationId
        base = _own.setdefault(app, f"file://{tempfile.mkdtemp(prefix='docweave-')}")
    return f"{base}/docweave/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the workspace: later steps don't compute them again, and survive lost executors."""
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
