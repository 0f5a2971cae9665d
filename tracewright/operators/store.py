"""Tables between steps, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A side of a join is broadcast only if its bytes, as counted, are no more than this.
BROADCAST_BYTES = 32 << 20
_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir or setCheckpointDir() names; a temporary one in single-process local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="tracewright-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return "file://" + _own[0]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: what reads it starts from files that outlive executors, and computes df once."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, width: int | Column = 64) -> DataFrame:
    """df hinted for a broadcast if its rows, of width bytes, are counted to be few enough, else as it is."""
    size = df.agg(F.sum(F.lit(width).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df
