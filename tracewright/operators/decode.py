"""Signals decoded from payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tracewright.functions.ids import decode_bits


def decode(frames: DataFrame, signals: DataFrame, watch: list[str] | None = None) -> DataFrame:
    """(frame columns, signal, value) of the frames whose id has signals (can_id, name, bits, signed); NaN if a payload is
    too short. An error if a watched id has no signal."""
    if watch is not None:
        have = {r[0] for r in signals.where(F.col("can_id").isin(watch)).select("can_id").distinct().collect()}
        if missing := sorted(set(watch) - have):
            raise ValueError(f"no signals for {missing}")
        signals = signals.where(F.col("can_id").isin(watch))
    own = frames.join(signals.select("can_id", "name", "bits", "signed"), "can_id")
    return own.select(*frames.columns, F.concat_ws(":", "can_id", "name").alias("signal"), decode_bits(F.col("payload"), F.col("bits"), F.col("signed")).alias("value"))


def decoded_windows(decoded: DataFrame) -> DataFrame:
    """(capture_id, w, signal, values): a window's values of each signal in frame order; NaN keeps its place."""
    one = F.array_sort(F.collect_list(F.struct("t_us", "line_no", "value")))
    return decoded.groupBy("capture_id", "w", "signal").agg(F.transform(one, lambda x: x["value"]).alias("values"))


def latest(decoded: DataFrame) -> DataFrame:
    """(capture_id, w, signal, value): the last value that is a number."""
    ok = decoded.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return ok.groupBy("capture_id", "w", "signal").agg(F.max_by("value", F.struct("t_us", "line_no")).alias("value"))


def check_csv(decoded: DataFrame, expected: DataFrame, most: int = 200_000) -> DataFrame:
    """Decoded values against a table (row, can_id, values), by position: (can_id, signal, compared, unequal, first_row).

    decoded is of one capture. Frames of ids without signals fall out before; then the i-th frame meets the i-th row, up
    to the shorter one's end and most rows. Another id in a pair is an error; empty expected values are passed over.
    """
    # Only the first most of either side are numbered, and each task finds its own first ones.
    frames_ = decoded.select("line_no", "can_id").distinct().orderBy("line_no").limit(most)
    numbered = frames_.withColumn("i", F.row_number().over(Window.orderBy("line_no")))
    rows = expected.orderBy("row").limit(most).withColumn("i", F.row_number().over(Window.orderBy("row"))).select("i", F.col("can_id").alias("other"), "values")
    pairs = numbered.join(rows, "i").withColumn("same", F.when(F.col("can_id") == F.col("other"), True).otherwise(F.raise_error(F.format_string("row %d is of %s, not %s", "i", "other", "can_id")).cast("boolean"))).where("same")
    want = pairs.select("i", "line_no", "can_id", F.inline("values")).select("i", "line_no", F.concat_ws(":", "can_id", "name").alias("signal"), F.col("value").alias("want"))
    both = want.join(decoded.select("line_no", "signal", "value"), ["line_no", "signal"])
    wrong = (F.col("want") != F.col("value")) | F.isnan("value")
    return both.groupBy("signal").agg(F.count(F.lit(1)).alias("compared"), F.count_if(wrong).alias("unequal"), F.min(F.when(wrong, F.col("i"))).alias("first_row"))


def preprocess(placed: DataFrame, spine: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """spine with decoded_signals, a map from each signal to its values in frame order; empty without signals.

    Frames are taken as they are, so attacks are injected before this. A window's values are as many as its frames.
    """
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<double>>"))
    if signals is None:
        return spine.withColumn("decoded_signals", none)
    own = decode(placed, signals).groupBy("capture_id", "w", "signal").agg(F.array_sort(F.collect_list(F.struct("t_us", "line_no", "value"))).alias("v"))
    maps = own.groupBy("capture_id", "w").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("signal", F.transform("v", lambda x: x["value"]).alias("values"))))).alias("m"))
    return spine.join(maps, ["capture_id", "w"], "left").withColumn("decoded_signals", F.coalesce("m", none)).drop("m")
