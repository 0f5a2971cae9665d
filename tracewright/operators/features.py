"""Timing features by sender and payload features by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.functions.ids import hex_value
from tracewright.operators import sums

TIMING = ("unknown_ids", "rate_excess", "short_gaps")
PAYLOAD = ("out_of_range", "frozen_break", "large_jump")
MIN_GAP_US = 1


def per_id(placed: DataFrame) -> DataFrame:
    """For each window and id: n, first (the place of its first frame) and min_gap_us inside the window."""
    gap = F.col("t_us") - F.lag("t_us").over(Window.partitionBy("capture_id", "w", "can_id").orderBy("t_us", "line_no"))
    return placed.withColumn("gap", gap).groupBy("capture_id", "w", "can_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t_us", "line_no")).alias("first"), F.min("gap").alias("min_gap_us"))


def gaps(placed: DataFrame) -> DataFrame:
    """(capture_id, line_no, w, can_id, gap_us): times between frames of an id, inside windows only."""
    gap = F.col("t_us") - F.lag("t_us").over(Window.partitionBy("capture_id", "w", "can_id").orderBy("t_us", "line_no"))
    return placed.select("capture_id", "line_no", "w", "can_id", gap.alias("gap_us")).where("gap_us is not null")


def timing_scores(window_s: float) -> tuple[Column, Column, Column]:
    """Of a window's id joined with a model: whether the model lacks it, its rate against the normal one, and the normal
    median gap against its shortest gap (NULL where there is none)."""
    foreign, excess = F.col("rate").isNull(), F.col("n") / F.lit(window_s) / F.col("rate")
    short = F.col("median_gap") / (F.greatest("min_gap_us", F.lit(MIN_GAP_US)) / 1e6)
    return foreign, excess, F.when(F.col("median_gap").isNotNull() & (F.col("n") >= 2), short)


def payload_scores(mode: str) -> tuple[Column, Column, Column]:
    """Of a window's field (v_low, v_high, jump, n) joined with a model: how far it leaves the bounds, how remarkable it is
    that it holds still, and its step against the largest normal one; NULL or 0 where there is nothing."""
    over = F.greatest(F.col("bound_low") - F.col("v_low"), F.col("v_high") - F.col("bound_high"), F.lit(0)).cast("double")
    width = (F.col("bound_high") - F.col("bound_low")).cast("double")
    still = (F.col("n") >= 2) & (F.col("v_low") == F.col("v_high"))
    held = (F.col("high") - F.col("low")).cast("double") if mode == "width" else -F.log((F.col("constant") + 1) / (F.col("seen") + 2))
    jump = F.when(F.col("jump") > F.col("max_jump"), F.when(F.col("max_jump") > 0, F.col("jump") / F.col("max_jump")).otherwise(F.col("jump").cast("double")))
    return over / F.when(width > 0, width).otherwise(1.0), F.when(still, held), jump


def timing(ids: DataFrame, spine: DataFrame, model: DataFrame, window_s: float) -> DataFrame:
    """The three timing checks of every window in spine, with the ids that set them; 0 where nothing does.

    model: can_id, rate, median_gap. unknown_ids: frames of ids without a rate. rate_excess: the largest rate against
    the normal one. short_gaps: the largest normal median gap against the shortest gap.
    """
    known = ids.join(model, "can_id", "left")
    order = F.struct((-F.col("first.t_us")).alias("t"), (-F.col("first.line_no")).alias("l"))
    foreign, excess, short = timing_scores(window_s)
    top = lambda score, when: F.max(F.when(when & (score > 0), F.struct(score.alias("v"), order.alias("o"), F.col("can_id").alias("id"))))
    own = known.groupBy("capture_id", "w").agg(
        F.sum(F.when(foreign, F.col("n")).otherwise(0)).cast("double").alias("unknown_ids"), F.count_if(foreign).alias("unknown_kinds"), top(F.col("n"), foreign).alias("u"), top(excess, ~foreign).alias("r"),
        top(short, ~foreign).alias("s"),
    )
    every = spine.join(own, ["capture_id", "w"], "left")
    return every.select(
        *spine.columns, F.coalesce("unknown_ids", F.lit(0.0)).alias("unknown_ids"), F.coalesce("r.v", F.lit(0.0)).alias("rate_excess"), F.coalesce("s.v", F.lit(0.0)).alias("short_gaps"), F.coalesce("unknown_kinds", F.lit(0)).alias("unknown_kinds"),
        F.col("u.id").alias("unknown_id"), F.col("u.v").alias("unknown_n"), F.col("r.id").alias("rate_id"), F.col("s.id").alias("gap_id"),
    )


def fields(frames: DataFrame) -> DataFrame:
    """A row for each frame and field of its payload: every byte, and every pair of neighbours in both orders.

    field_no: bytes first, then pairs, each big-endian before little-endian.
    """
    n = F.expr("length(payload) div 2")
    byte = lambda i: hex_value(F.substring("payload", i * 2 + 1, F.lit(2)))
    make = lambda no, name, value: F.struct(no.cast("int").alias("field_no"), name.alias("field"), value.alias("value"))
    one = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: make(i, F.concat(F.lit("byte"), i), byte(i))))

    def two(i: Column) -> Column:
        at = lambda end: F.concat(F.lit("pair"), i, F.lit(end))
        return F.array(make(n + 2 * i, at("_be"), byte(i) * 256 + byte(i + 1)), make(n + 2 * i + 1, at("_le"), byte(i + 1) * 256 + byte(i)))

    none = F.array().cast("array<struct<field_no:int,field:string,value:long>>")
    pairs = F.when(n > 1, F.flatten(F.transform(F.sequence(F.lit(0), n - 2), two))).otherwise(none)
    return frames.where(n > 0).select(*frames.columns, F.inline(F.concat(one, pairs))).drop("payload")


def watched(frames: DataFrame, ids: list[str] | None) -> DataFrame:
    """Frames of the watched ids; None watches all. An id is a partition key below, so Spark pushes this to the scan."""
    if ids is None:
        return frames
    if not ids:
        raise ValueError("an empty watch-list watches nothing")
    return frames.where(F.col("can_id").isin([i.upper() for i in ids]))


def per_field(placed: DataFrame) -> DataFrame:
    """For each window, id and field: n, low, high, jump (largest step between neighbours), first, the first value's place,
    id_t and id_line, that of the id, and the opening and closing value; from one sort of the frames."""
    return sums.per_field(sums.summed(placed))


def ranges(frames: DataFrame, us: int = 1_000_000) -> DataFrame:
    """For each capture, id and field over all its frames: low, high, jump. Steps don't cross captures; a frame too short
    for a field is passed over. us only cuts the work into parts: captures are summed by windows, then joined up. A row
    a window, id and field stands between, so us should be long enough to hold many frames."""
    return sums.ranges(sums.of_frames(frames, us, times=False))


def turns(frames: DataFrame) -> DataFrame:
    """(capture_id, can_id, field, value): a field's first value in a capture and each one that differs from the last."""
    before = F.lag("value").over(Window.partitionBy("capture_id", "can_id", "field").orderBy("t_us", "line_no"))
    return fields(frames).withColumn("before", before).where("before is null or before <> value").select("capture_id", "can_id", "field", "value")


def merged(stats: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Ranges of several captures as one: the lowest low, the highest high, the largest jump."""
    return stats.groupBy(*(by or []), "can_id", "field").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("jump").alias("jump"))


def frozen(window_fields: DataFrame, by: list[str] | None = None) -> DataFrame:
    """For each id and field: seen, the windows with two values or more, and constant, those of them that hold still."""
    return window_fields.where("n >= 2").groupBy(*(by or []), "can_id", "field").agg(F.count_if(F.col("low") == F.col("high")).alias("constant"), F.count(F.lit(1)).alias("seen"))


def payload(window_fields: DataFrame, spine: DataFrame, model: DataFrame, mode: str = "width") -> DataFrame:
    """The three payload checks of every window in spine, with the id and field that set each; 0 where nothing does.

    model: can_id, field, low, high, bound_low, bound_high, max_jump, constant, seen; fields without a row are passed
    over. out_of_range: how far values leave the bounds, in widths of these. frozen_break: of fields that hold still, the
    normal width, or by rate the surprise. large_jump: steps beyond the normal largest, against it.
    """
    known = window_fields.withColumnsRenamed({"low": "v_low", "high": "v_high"}).join(model, ["can_id", "field"])
    out, frozen_, jump = payload_scores(mode)
    order = F.struct(*[(-F.col(c)).alias(c) for c in ("id_t", "id_line", "first")])
    top = lambda score: F.max(F.when(score > 0, F.struct(score.alias("v"), order.alias("o"), F.concat_ws(" ", "can_id", "field").alias("at"))))
    own = known.groupBy("capture_id", "w").agg(top(out).alias("o"), top(frozen_).alias("f"), top(jump).alias("j"))
    every = spine.join(own, ["capture_id", "w"], "left")
    return every.select(
        *spine.columns, F.coalesce("o.v", F.lit(0.0)).alias("out_of_range"), F.coalesce("f.v", F.lit(0.0)).alias("frozen_break"), F.coalesce("j.v", F.lit(0.0)).alias("large_jump"),
        F.col("o.at").alias("range_at"), F.col("f.at").alias("frozen_at"), F.col("j.at").alias("jump_at"),
    )
