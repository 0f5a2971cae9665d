"""Injected frames and window labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracewright.functions.ids import mask_match
from tracewright.operators import windows


def is_injected(kind: Column, target: Column, lo: Column, hi: Column, mask: Column, can_id: Column, t: Column, payload: Column) -> Column:
    """Whether a frame was injected, by its capture's rule; the interval is closed.

    fuzzing: the payload is 16 F. masquerade: the target inside the interval. fabrication: so, with the mask. Others: no.
    """
    aimed = (can_id == target) & t.between(lo, hi)
    found = F.when(kind == "fuzzing", payload == "F" * 16).when(kind == "masquerade", aimed).when(kind == "fabrication", aimed & F.coalesce(mask_match(payload, mask), F.lit(False)))
    return F.coalesce(found, F.lit(False))


def injected(frames: DataFrame, rules: DataFrame) -> DataFrame:
    """Frames with injected, by rules (capture_id, kind, target, lo_us, hi_us, mask)."""
    own = frames.join(rules.select("capture_id", "kind", "target", "lo_us", "hi_us", "mask"), "capture_id", "left")
    mark = is_injected(*[F.col(c) for c in ("kind", "target", "lo_us", "hi_us", "mask", "can_id", "t_us", "payload")])
    return own.select(*frames.columns, mark.alias("injected"))


def window_labels(frames: DataFrame, rules: DataFrame, us: int) -> DataFrame:
    """Every window's label: is_attack if a frame in it was injected, then with family, target, the rule's interval and
    the seconds of it in the window; a normal window has NULLs and 0 frames."""
    counts = windows.assign(injected(frames, rules), us).groupBy("capture_id", "w").agg(F.count_if("injected").alias("m"))
    every = windows.spine(frames, us).join(counts, ["capture_id", "w"], "left").join(rules, "capture_id", "left")
    attack = F.coalesce(F.col("m") > 0, F.lit(False))
    overlap = F.greatest(F.lit(0), F.least("end_us", "hi_us") - F.greatest("start_us", "lo_us")) / 1e6
    timed = attack & F.col("lo_us").isNotNull()
    interval = F.when(timed, F.struct((F.col("lo_us") / 1e6).alias("start"), (F.col("hi_us") / 1e6).alias("end")))
    return every.select(
        "window_id", "capture_id", "w", "kind", attack.alias("is_attack"), F.when(attack, F.col("family")).alias("family"), F.when(attack, F.col("target")).alias("target"), interval.alias("injection_interval"),
        F.coalesce("m", F.lit(0)).cast("long").alias("injected_frames"), F.when(timed, overlap).alias("interval_overlap_s"),
    )


def without_twins(labelled: DataFrame) -> DataFrame:
    """Labelled windows without masquerade recordings' normal ones, which their twins have as well."""
    return labelled.where(~((F.col("kind") == "masquerade") & ~F.col("is_attack")))
