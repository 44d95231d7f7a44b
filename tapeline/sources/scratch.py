"""Paths for intermediate tables and stream checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder of spark.checkpoint.dir; a temporary one where that is unset and Spark runs on this
    machine alone. On a cluster an unset folder is an error: its machines share no other."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="tapeline-")
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


def written(rows: DataFrame, tag: str) -> DataFrame:
    """The rows, written to such a path and read again: a table that a plan reads many times is made once."""
    path = scratch(rows.sparkSession, tag)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
