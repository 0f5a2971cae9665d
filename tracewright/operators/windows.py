"""Tumbling windows with empty ones, and features of their parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewright.functions.ids import window_id

BINS = 10


def window_us(window_s: float, stride_s: float | None = None) -> int:
    """A window's length in microseconds; windows must not overlap, and must be whole microseconds."""
    us = round(window_s * 1_000_000)
    if us <= 0 or abs(us - window_s * 1_000_000) > 1e-6:
        raise ValueError(f"a window of {window_s} s is not a positive number of whole microseconds")
    if stride_s is not None and stride_s != window_s:
        raise ValueError("overlapping or spaced windows are not supported")
    return us


def keep_every(span_us: Column, us: int, most: int) -> Column:
    """Of how many windows one is kept, so that about most are left."""
    return F.greatest(F.lit(1), F.ceil(F.floor(span_us / us) / most)).cast("long")


def spine(frames: DataFrame, us: int, every: int = 1) -> DataFrame:
    """All windows: capture_id, w, window_id, start_us, end_us; from 0 up to that of the last frame, which is left out."""
    last = frames.groupBy("capture_id").agg(F.max(F.expr(f"t_us div {us}")).alias("last_w")).where("last_w > 0")
    w = last.select("capture_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_w") - 1)).alias("w")).where(F.col("w") % every == 0)
    return w.select("capture_id", "w", window_id(F.col("capture_id"), F.col("w")).alias("window_id"), (F.col("w") * us).alias("start_us"), ((F.col("w") + 1) * us).alias("end_us"))


def assign(frames: DataFrame, us: int, every: int = 1) -> DataFrame:
    """Frames with w, without those of each capture's last window and of windows that are not kept."""
    placed = frames.withColumn("w", F.expr(f"t_us div {us}"))
    last = placed.groupBy("capture_id").agg(F.max("w").alias("last_w"))
    return placed.join(last, "capture_id").where((F.col("w") < F.col("last_w")) & (F.col("w") % every == 0)).drop("last_w")


def counted(frames: DataFrame, us: int) -> DataFrame:
    """Every window with its number of frames and of ids, 0 for empty ones."""
    own = assign(frames, us).groupBy("capture_id", "w").agg(F.count(F.lit(1)).alias("n_frames"), F.countDistinct("can_id").alias("n_ids"))
    return spine(frames, us).join(own, ["capture_id", "w"], "left").fillna(0, ["n_frames", "n_ids"])


def nested(frames: DataFrame, us: int) -> DataFrame:
    """Windows with their frames inside, in order, in seconds: the view for single-window tools."""
    one = F.struct(F.col("t_us"), F.col("line_no"), (F.col("t_us") / 1e6).alias("timestamp"), "can_id", "payload")
    own = assign(frames, us).groupBy("capture_id", "w").agg(F.array_sort(F.collect_list(one)).alias("f"))
    out = F.transform(F.coalesce("f", F.array().cast("array<struct<t_us:long,line_no:long,timestamp:double,can_id:string,payload:string>>")), lambda x: F.struct(x["timestamp"].alias("timestamp"), x["can_id"].alias("can_id"), x["payload"].alias("payload")))
    return spine(frames, us).join(own, ["capture_id", "w"], "left").select("window_id", "capture_id", (F.col("start_us") / 1e6).alias("window_start"), (F.col("end_us") / 1e6).alias("window_end"), out.alias("frames"))


def bins(frames: DataFrame, us: int, watch: list[str], n: int = BINS) -> DataFrame:
    """Every window's parts: bin and log(1 + x) of its frames, distinct ids and watched frames."""
    inside = F.col("t_us") - F.col("w") * us
    bin_ = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(inside / (us / n)).cast("int")))
    own = assign(frames, us).groupBy("capture_id", "w", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("can_id").alias("ids"), F.count_if(F.col("can_id").isin(watch)).alias("watched"))
    every = spine(frames, us).select("capture_id", "w", "window_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin"))
    full = every.join(own, ["capture_id", "w", "bin"], "left").fillna(0, ["n", "ids", "watched"])
    return full.select("window_id", "bin", F.log1p("n").alias("log_frames"), F.log1p("ids").alias("log_ids"), F.log1p("watched").alias("log_watched"))


def wrong_length(windows: DataFrame, us: int) -> DataFrame:
    """Windows that are not as long as a model's."""
    return windows.where(F.col("end_us") - F.col("start_us") != us)


def quota(frames: DataFrame, us: int, captures: list[str], most: int | None = None) -> dict[str, int]:
    """How many windows of each capture to take, in the order given, so that most are taken in all. Captures are measured
    one, two, four at a time, and no further once the quota is filled; None takes all of all."""
    taken: dict[str, int] = {}
    left, at, size = most, 0, 1
    while at < len(captures) and (left is None or left > 0):
        some = captures[at : at + size]
        last = {r["capture_id"]: r["n"] for r in frames.where(F.col("capture_id").isin(some)).groupBy("capture_id").agg(F.max(F.expr(f"t_us div {us}")).alias("n")).collect()}
        for c in some:
            n = last.get(c, 0) if left is None else min(last.get(c, 0), left)
            if n:
                taken[c] = n
            left = None if left is None else left - n
        at, size = at + size, size * 2
    return taken


def real(frames: DataFrame, us: int, captures: list[str], most: int | None = None) -> DataFrame:
    """The first windows of captures, in the order given, most at the most: window_id, capture_id, w, place, n_frames, n_ids.

    Frames of captures beyond the quota are not read. An error if there are no captures, or no windows in them.
    """
    if not captures:
        raise ValueError("no captures to read")
    taken = quota(frames, us, captures, most)
    if not taken:
        raise ValueError(f"captures {captures} hold no window")
    spark = frames.sparkSession
    starts, rows = 0, []
    for c, n in taken.items():
        rows.append((c, n, starts))
        starts += n
    limits = spark.createDataFrame(rows, "capture_id string, take long, start long")
    own = frames.where(F.col("capture_id").isin(list(taken))).withColumn("w", F.expr(f"t_us div {us}"))
    sums_ = own.join(F.broadcast(limits), "capture_id").where("w < take").groupBy("capture_id", "w").agg(F.count(F.lit(1)).alias("n_frames"), F.countDistinct("can_id").alias("n_ids"))
    every = limits.select("capture_id", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("take") - 1)).alias("w"))
    full = every.join(sums_, ["capture_id", "w"], "left").fillna(0, ["n_frames", "n_ids"])
    return full.select(window_id(F.col("capture_id"), F.col("w")).alias("window_id"), "capture_id", "w", (F.col("start") + F.col("w")).alias("place"), "n_frames", "n_ids")
