"""Windows of a stream of frames, by state for each capture."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewright.sources import logs

OUT = "capture_id string, w long, n_frames long, first_us long, last_us long"
STATE = "w long, n long, first_us long, last_us long"


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of parsed lines of the log files that appear in a folder: (capture, abs_us, can_id, payload)."""
    lines = spark.readStream.text(folder).select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1).alias("capture"), F.lit(0).cast("long").alias("line_no"), "value")
    return logs.parse(lines).where("abs_us is not null").select("capture", "abs_us", "can_id", "payload")


def dedup(frames: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Frames (capture_id, t_us, can_id, payload) without exact repeats; what is older than the watermark is forgotten.

    A watermark is of the whole stream, so captures must not lie far apart in it, or each has a query of its own.
    """
    timed = frames.withColumn("ts", F.timestamp_micros("t_us")).withWatermark("ts", delay)
    return timed.dropDuplicatesWithinWatermark(["capture_id", "t_us", "can_id", "payload"])


def tumbling(frames: DataFrame, us: int) -> DataFrame:
    """(capture_id, w, n_frames, first_us, last_us): windows of a stream of frames as soon as a later one has begun.

    Empty windows between are given with 0 frames; a capture's newest window is held back, which drops its last one as
    in batch. A frame in a window that is over is an error, as captures are in order.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        w, n, first, last = state.get if state.exists else (0, 0, None, None)
        times = pd.concat([b["t_us"] for b in batches]).sort_values() if batches else pd.Series([], dtype="int64")
        counts = times.groupby(times // us).agg(["size", "min", "max"])
        done = []
        for at, (size, low, high) in zip(counts.index.tolist(), counts.itertuples(index=False)):
            if at < w:
                raise ValueError(f"capture {key[0]} is out of order: window {at} after {w}")
            if at > w:
                done.append((key[0], w, n, first, last))
                done.extend((key[0], k, 0, None, None) for k in range(w + 1, at))
                w, n, first, last = at, 0, None, None
            n, first, last = n + int(size), int(low) if first is None else first, int(high)
        state.update((w, n, first, last))
        yield pd.DataFrame(done, columns=["capture_id", "w", "n_frames", "first_us", "last_us"]).astype({"first_us": "Int64", "last_us": "Int64"})

    return frames.select("capture_id", "t_us").groupBy("capture_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def watermarked(frames: DataFrame, us: int, delay: str = "0 seconds") -> DataFrame:
    """Counts of the windows that have frames, by Spark's own event-time windows; empty ones are not given."""
    timed = frames.withColumn("ts", F.timestamp_micros("t_us")).withWatermark("ts", delay)
    return timed.groupBy("capture_id", F.window("ts", f"{us} microseconds").alias("win")).agg(F.count(F.lit(1)).alias("n_frames")).select("capture_id", F.expr(f"unix_micros(win.start) div {us}").alias("w"), "n_frames")
