"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: What separates the words of a text once A-Z are lower case: all of ASCII but digits and a-z.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same as a table for bytes.translate: A-Z to a-z, other separators to blanks, UTF-8 bytes as they are.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
#: A side is broadcast only if its bytes, as counted, are no more than this.
BROADCAST_BYTES = 32 << 20

_own: list[str] = []


def word_list(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8 bytes; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def lower_ascii(col: Column) -> Column:
    return F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER)


def words(col: Column) -> Column:
    """The words of a text as an array column; null has none."""
    return F.filter(F.split(lower_ascii(col), GAP), lambda w: w != "")


def shared_dir(spark: SparkSession, kind: str) -> str:
    """A new folder's URI below the folder that driver and executors share.

    The cluster names it in spark.checkpoint.dir, or setCheckpointDir() did. Only where neither is set and Spark runs
    in one process, as in tests, a temporary folder of this machine takes its place and goes when the process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tracewright-"))
            atexit.register(shutil.rmtree, _own[0], True)
        root = "file://" + _own[0]
    return f"{root.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def mounted(uri: str) -> str:
    """The path of a shared folder that every worker can open by name."""
    at = urlparse(uri)
    if at.scheme not in ("", "file"):
        raise ValueError(f"this operator's workers map files, so the shared folder must be mounted, not {uri}")
    os.makedirs(at.path, exist_ok=True)
    return at.path


def cut(df: DataFrame, kind: str) -> DataFrame:
    """df written to the shared folder and read back: later steps start from files that outlive executors."""
    spark = df.sparkSession
    path = shared_dir(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that go as soon as no later step reads them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def cut(self, df: DataFrame, kind: str) -> DataFrame:
        """As cut(); the table stays until it is dropped."""
        path = shared_dir(self.spark, kind)
        df.write.parquet(path)
        made = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(made)] = made, path
        return made

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that cut() returned, all of them if none is given. Nothing that still has to be computed may read them."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        for made in tables or [t for t, _ in self.paths.values()]:
            path = hadoop(self.paths.pop(id(made))[1])
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, width: int | Column) -> DataFrame:
    """df with a broadcast hint if its rows are counted to have at most BROADCAST_BYTES, else df for a shuffled join.

    width: the bytes of a row; a Column where rows differ.
    """
    size = df.agg(F.sum(F.lit(width).cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_rows(left: DataFrame, right: DataFrame, how: str, h: str = "h", width: int | Column = 64) -> DataFrame:
    """left joined with right on the row's identity, doc_id and a hash of its text, either of which may be null.

    doc_ids may repeat or be null, so a doc_id alone does not name a row. right is hinted to be broadcast only if its
    bytes, width a row, are counted to be few. left's columns come first, then right's others.
    """
    names = [c for c in right.columns if c not in ("doc_id", "h")]
    own = small(right, width).select(F.col("doc_id").alias("_right_id"), F.col("h").alias("_right_h"), *names)
    return left.join(own, F.col("doc_id").eqNullSafe(F.col("_right_id")) & F.col(h).eqNullSafe(F.col("_right_h")), how).drop("_right_id", "_right_h")
