"""Proposing, checking and injecting synthetic attacks, and what is made of those that are missed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.functions.ids import hex_value

MAGNITUDE = 120


def propose_freeze(placed: DataFrame, us: int) -> DataFrame:
    """For each window the id with most payloads unlike its first one (of equal ones the lowest), to be frozen all along;
    windows in which nothing changes have no row."""
    by_id = Window.partitionBy("capture_id", "w", "can_id").orderBy("t_us", "line_no")
    changed = placed.withColumn("first_payload", F.first("payload").over(by_id)).groupBy("capture_id", "w", "can_id").agg(F.count_if(F.col("payload") != F.col("first_payload")).alias("changes")).where("changes > 0")
    best = changed.groupBy("capture_id", "w").agg(F.min(F.struct((-F.col("changes")).alias("c"), hex_value(F.col("can_id")).alias("v"), "can_id")).alias("b"))
    return best.select("capture_id", "w", F.lit("freeze").alias("family"), F.col("b.can_id").alias("target_can_id"), F.lit(0.0).alias("start_offset_ms"), F.lit(us / 1000.0).alias("duration_ms"), F.lit(None).cast("int").alias("byte_index"), F.lit(None).cast("int").alias("offset"))


def propose_offset(placed: DataFrame, us: int) -> DataFrame:
    """For each window the steadiest byte (then the lowest id, then byte), to be pushed towards the farther end."""
    n = F.expr("length(payload) div 2")
    bytes_ = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("byte_index"), hex_value(F.substring("payload", i * 2 + 1, F.lit(2))).alias("value")))
    each = placed.where(n > 0).select("capture_id", "w", "can_id", F.inline(bytes_))
    spread = each.groupBy("capture_id", "w", "can_id", "byte_index").agg((F.max("value") - F.min("value")).alias("spread"), F.avg("value").alias("mean"))
    best = spread.groupBy("capture_id", "w").agg(F.min(F.struct("spread", hex_value(F.col("can_id")).alias("v"), "byte_index", "can_id", "mean")).alias("b"))
    push = F.when(F.col("b.mean") <= 127, MAGNITUDE).otherwise(-MAGNITUDE)
    return best.select("capture_id", "w", F.lit("offset").alias("family"), F.col("b.can_id").alias("target_can_id"), F.lit(0.0).alias("start_offset_ms"), F.lit(us / 1000.0).alias("duration_ms"), F.col("b.byte_index").cast("int").alias("byte_index"), push.alias("offset"))


def _aimed(us: int) -> Column:
    """Whether a frame is the target's and inside the interval, which is half-open."""
    start = F.col("w") * us / 1000.0 + F.col("start_offset_ms")
    return (F.upper("can_id") == F.upper("target_can_id")) & (F.col("t_us") / 1000.0 >= start) & (F.col("t_us") / 1000.0 < start + F.col("duration_ms"))


def _pushed() -> Column:
    """The payload with its byte moved by the offset, within 0..255; one that is too short stays."""
    at = F.col("byte_index") * 2 + 1
    byte = hex_value(F.substring("payload", at, F.lit(2)))
    moved = F.greatest(F.lit(0), F.least(F.lit(255), byte + F.col("offset")))
    fits = F.length("payload") >= at + 1
    return F.when(fits & (moved != byte), F.upper(F.overlay("payload", F.format_string("%02X", moved.cast("long")), at, F.lit(2)))).otherwise(F.col("payload"))


def guarded(specs: DataFrame, us: int) -> DataFrame:
    """specs, whose use fails if an attack's interval does not reach into its window."""
    fits = (F.col("duration_ms") > 0) & (F.col("start_offset_ms") >= 0) & (F.col("start_offset_ms") * 1000 < us)
    told = F.format_string("the attack on %s, window %d, does not overlap its window", "capture_id", "w")
    return specs.withColumn("family", F.when(fits, F.col("family")).otherwise(F.raise_error(told).cast("string")))


def inject(placed: DataFrame, specs: DataFrame, us: int, variant: int = 1) -> DataFrame:
    """The frames of each attacked window, with its changes: freeze repeats the target's first payload in the interval,
    offset moves a byte. Adds attacked_window_id, changed and the old payload; specs: capture_id, w and a proposal."""
    if "decoded_signals" in placed.columns:
        raise ValueError("attacks are injected into raw frames, before signals are decoded")
    own = placed.join(guarded(specs, us), ["capture_id", "w"]).withColumn("aimed", _aimed(us))
    order = Window.partitionBy("capture_id", "w", "family").orderBy(~F.col("aimed"), "t_us", "line_no")
    own = own.withColumn("frozen", F.first("payload").over(order))
    new = F.when(F.col("aimed") & (F.col("family") == "freeze"), F.col("frozen")).when(F.col("aimed") & (F.col("family") == "offset"), _pushed()).otherwise(F.col("payload"))
    own = own.withColumn("new_payload", new)
    return own.select(
        F.format_string(f"%s_w%04d_v{variant:02d}", "capture_id", "w").alias("attacked_window_id"), "capture_id", "w", "family", "line_no", "t_us", "can_id", F.col("payload").alias("old_payload"), F.col("new_payload").alias("payload"),
        (F.col("new_payload") != F.col("payload")).alias("changed"),
    )


def freeze_id(frames: DataFrame, can_id: str, payload: str) -> DataFrame:
    """Frames whose every payload of an id is one value."""
    return frames.withColumn("payload", F.when(F.col("can_id") == can_id, F.lit(payload)).otherwise(F.col("payload")))


def validate(placed: DataFrame, spine: DataFrame, specs: DataFrame, us: int, allowed: list[str] | None = None) -> DataFrame:
    """For each proposal whether it can change its window, why not, and how many frames match and would change.

    In this order: family, allowed ids, interval against the window, matching frames, changes.
    """
    own = specs.join(spine.select("capture_id", "w", "window_id"), ["capture_id", "w"])
    hit = placed.join(specs, ["capture_id", "w"]).where(_aimed(us))
    first = F.first("payload").over(Window.partitionBy("capture_id", "w", "family").orderBy("t_us", "line_no"))
    change = F.when(F.col("family") == "freeze", F.col("payload") != F.col("first_payload")).otherwise(_pushed() != F.col("payload"))
    counts = hit.withColumn("first_payload", first).groupBy("capture_id", "w", "family").agg(F.count(F.lit(1)).alias("matching"), F.count_if(change).alias("changed"))
    both = own.join(counts, ["capture_id", "w", "family"], "left").fillna(0, ["matching", "changed"])
    reason = F.when(~F.col("family").isin("freeze", "offset"), "no such kind of attack")
    if allowed is not None:
        reason = reason.when(~F.upper("target_can_id").isin([a.upper() for a in allowed]), "this id may not be attacked")
    reason = reason.when((F.col("start_offset_ms") * 1000 >= us) | (F.col("start_offset_ms") + F.col("duration_ms") <= 0), "it would lie outside the window")
    reason = reason.when(F.col("matching") == 0, "no frame of the id in that time").when((F.col("changed") == 0) & (F.col("family") == "freeze"), "all these payloads are equal already")
    reason = reason.when(F.col("changed") == 0, "no byte there could move").otherwise("it changes frames")
    told = reason.isin("no such kind of attack", "this id may not be attacked", "it would lie outside the window")
    return both.select("window_id", "family", "target_can_id", (reason == "it changes frames").alias("valid"), reason.alias("reason"), F.when(told, 0).otherwise(F.col("matching")).alias("matching"), F.when(told, 0).otherwise(F.col("changed")).alias("changed"))


def evasions(specs: DataFrame, results: DataFrame, split: str = "development") -> DataFrame:
    """The missed attacks of a development run: specs (attack_id, window_id, ...) whose result is FN and of their family."""
    if split != "development":
        raise ValueError("misses are kept from development only")
    missed = results.where("outcome = 'FN'").select("window_id", F.col("family").alias("of"), "attack_score", "model_version")
    return specs.join(missed, "window_id").where("family = of").select("attack_id", "window_id", "family", "target_can_id", "start_offset_ms", "duration_ms", "attack_score", "model_version", F.lit(split).alias("split"))


def rejected(evasions_: DataFrame, development: DataFrame, version: str) -> DataFrame:
    """Evasions that may not be trained on: (window_id, reason)."""
    known = evasions_.join(development.select("window_id").distinct().withColumn("known", F.lit(True)), "window_id", "left")
    reason = F.when(F.col("split") != "development", "not from development").when(F.col("model_version") != version, "another model version").when(F.col("known").isNull(), "not in the development manifest")
    return known.select("window_id", reason.alias("reason")).where("reason is not null")


def hardening_set(evasions_: DataFrame, development: DataFrame, version: str) -> DataFrame:
    """The distinct windows to train on, in order; an error if one may not be."""
    if bad := rejected(evasions_, development, version).limit(1).collect():
        raise ValueError(f"evasion {bad[0]['window_id']} is {bad[0]['reason']}")
    return evasions_.select("window_id").distinct().orderBy("window_id")


def diagnose(evasions_: DataFrame, watch: list[str] | None) -> DataFrame:
    """Misses by family and target, and whether their target was watched: coverage gaps against sensitivity gaps."""
    seen = F.lit(True) if watch is None else F.col("target_can_id").isin([x.upper() for x in watch])
    return evasions_.groupBy("family", "target_can_id").agg(F.count(F.lit(1)).alias("misses"), F.count_distinct("window_id").alias("windows"), F.count_if(~seen).alias("coverage_gap"), F.count_if(seen).alias("sensitivity_gap"))
