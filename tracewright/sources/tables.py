"""Frames from a generic event table, and mock traffic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Six hours, the window of the event table.
EVENT_WINDOW_US = 21_600_000_000
#: Identifiers for the kinds of events; any other kind is 0F4.
EVENT_IDS = {"click": "0C1", "error": "0E0", "purchase": "0B0", "signup": "0A0"}
CAPTURES = 20
#: Mock senders and their periods in microseconds. Fixed values.
MOCK_PERIODS = {"0D0": 10_000, "0F4": 20_000, "1A0": 50_000}


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as frames: capture_id, line_no, t_us, can_id, payload.

    Users make 20 captures; an event's kind is its identifier; value in cents and the k of props are its payload.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    can_id = F.lit("0F4")
    for kind, name in EVENT_IDS.items():
        can_id = F.when(F.col("event_type") == kind, name).otherwise(can_id)
    k = F.get_json_object("props", "$.k").cast("long")
    raw = e.select(
        F.format_string("cap%02d", F.col("user_id") % CAPTURES).alias("capture_id"), F.col("event_id").alias("line_no"), F.unix_micros(F.col("ts").cast("timestamp")).alias("abs_us"),
        can_id.alias("can_id"), F.format_string("%04X%02X", F.round(F.col("value") * 100).cast("long") % 65536, k % 256).alias("payload"),
    )
    zero = raw.groupBy("capture_id").agg(F.min("abs_us").alias("zero"))
    return raw.join(F.broadcast(zero), "capture_id").select("capture_id", "line_no", (F.col("abs_us") - F.col("zero")).alias("t_us"), "can_id", "payload")  # at most CAPTURES rows


def event_roles(capture_id: Column) -> dict[str, Column]:
    """group, family and fold of those captures, which follow from the number in a capture's id: 0 to 2 modulo 5 train, 3
    validation, 4 development."""
    number = F.substring(capture_id, 4, 2).cast("int")
    return {"group": F.when(number % 5 == 3, "validation").when(number % 5 == 4, "development").otherwise("train"), "family": F.concat(F.lit("f"), (number % 3).cast("string")), "fold": number % 2 + 1}


def event_captures(frames: DataFrame) -> DataFrame:
    """A row for each of those captures with its role; errors in the middle third are injected."""
    roles = event_roles(F.col("capture_id"))
    last = frames.groupBy("capture_id").agg(F.max("t_us").alias("last_us"))
    return last.select(
        "capture_id", roles["group"].alias("group"), F.lit("masquerade").alias("kind"), roles["family"].alias("family"), F.lit("0E0").alias("target"), F.expr("last_us div 3").alias("lo_us"),
        F.expr("2 * last_us div 3").alias("hi_us"), F.lit(None).cast("string").alias("mask"), roles["fold"].alias("fold"),
    )


def mock_frames(spark: SparkSession, windows: int, window_us: int = 1_000_000) -> DataFrame:
    """Deterministic mock traffic: three periodic senders with jitter, every tenth window with ten foreign frames."""
    base = spark.range(windows).select(F.col("id").alias("w"))
    sent = None
    for can_id, period in MOCK_PERIODS.items():
        one = base.select("w", F.explode(F.sequence(F.lit(0), F.lit(window_us // period - 1))).alias("k")).select(
            "w", (F.lit(1000) + F.col("k") * period + ((F.col("w") * 7 + F.col("k") * 3) % 5 - 2) * 200).alias("at"), F.lit(can_id).alias("can_id"), F.lit("0011223344556677").alias("payload")
        )
        sent = one if sent is None else sent.union(one)
    foreign = base.where("w % 10 = 9").select("w", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")).select("w", (F.lit(100_000) + F.col("k") * 50_000).alias("at"), F.lit("7FF").alias("can_id"), F.lit("F" * 16).alias("payload"))
    t = F.col("w") * window_us + F.col("at")
    every = sent.union(foreign).where(F.col("at").between(0, window_us))
    return every.select(F.lit("cap90").alias("capture_id"), (t * 8 + F.pmod(F.hash("can_id"), F.lit(8))).alias("line_no"), t.alias("t_us"), "can_id", "payload")
