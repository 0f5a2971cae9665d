"""Duplicates, order and the cleaning report."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tracewright.operators.store import small
from tracewright.sources.logs import MAX_REMOVED

KEY = ["capture_id", "t_us", "can_id", "payload"]
FILLER = "FFF"
#: Lines of a capture that one task checks at once.
BLOCK_LINES = 1 << 20


def dedup(frames: DataFrame) -> DataFrame:
    """Frames without exact repeats in time, id and payload; the first line stays.

    A sum by key, so tasks drop repeats before anything is shuffled.
    """
    return frames.groupBy(*KEY).agg(F.min("line_no").alias("line_no")).select("capture_id", "line_no", "t_us", "can_id", "payload")


def order_violations(frames: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Frames whose time is before that of the line above: capture_id, line_no, t_us, previous_us.

    Lines are checked block by block, so a long capture is many tasks' work; a block's first line is held against the last
    one of the block before, of which there is a row each.
    """
    own = frames.select("capture_id", "line_no", "t_us", F.floor(F.col("line_no") / block_lines).alias("block"))
    edges = own.groupBy("capture_id", "block").agg(F.max_by("t_us", "line_no").alias("last_us"))
    carried = edges.select("capture_id", "block", F.lag("last_us").over(Window.partitionBy("capture_id").orderBy("block")).alias("carried"))
    above = F.lag("t_us").over(Window.partitionBy("capture_id", "block").orderBy("line_no"))
    every = own.withColumn("above", above).join(small(carried), ["capture_id", "block"])
    return every.select("capture_id", "line_no", "t_us", F.coalesce("above", "carried").alias("previous_us")).where("t_us < previous_us")


def report(frames: DataFrame, kept: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """One row a capture: read, kept, duplicates, skipped_lines, filler, removed_fraction (8 digits; 0 of nothing)."""
    read = frames.groupBy("capture_id").agg(F.count(F.lit(1)).alias("read"))
    left = kept.groupBy("capture_id").agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.col("can_id") == FILLER).alias("filler"))
    both = read.join(left, "capture_id", "left")
    both = both.join(skipped, "capture_id", "full") if skipped is not None else both.withColumn("skipped_lines", F.lit(0).cast("long"))
    both = both.fillna(0, ["read", "kept", "filler", "skipped_lines"])
    gone, all_ = F.col("read") - F.col("kept") + F.col("skipped_lines"), F.col("read") + F.col("skipped_lines")
    fraction = F.round(F.coalesce(F.try_divide(gone.cast("double"), all_.cast("double")), F.lit(0.0)), 8)
    return both.select("capture_id", "read", "kept", (F.col("read") - F.col("kept")).alias("duplicates"), "skipped_lines", "filler", fraction.alias("removed_fraction"))


def gate(report_: DataFrame, most: float = MAX_REMOVED) -> DataFrame:
    """The captures that lost more than they may."""
    gone = (F.col("duplicates") + F.col("skipped_lines")).cast("double")
    return report_.where(gone > F.lit(most) * (F.col("read") + F.col("skipped_lines")))


def cleaned(frames: DataFrame) -> DataFrame:
    """dedup(frames), after a check that every capture is in order; an error if one is not."""
    bad = order_violations(frames).limit(1).collect()
    if bad:
        raise ValueError(f"capture {bad[0]['capture_id']} is out of order at line {bad[0]['line_no']}")
    return dedup(frames)
