"""Where work files go."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where that is unset a local one is made, if driver and executor are one process; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spanmill-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/spanmill-{uuid.uuid4().hex}"


def dealt(df: DataFrame) -> DataFrame:
    """df in some partitions for each core: rows of a file that one task reads, such as one row group, are costly further on."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """df written to a new shared folder and read back: its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
