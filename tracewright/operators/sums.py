"""Every window's sums by sender and by payload field, from one sort of the frames.

Frames are sorted once, by capture, window, sender and time. Each is paired with what stands before it, and the pairs are
taken apart into partial minima, maxima and counts; no row per field is ever sorted. All features of both stages, and the
whole captures' ranges, come from these sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.functions.ids import hex_value, window_id

#: Bytes of the longest payload.
MOST_BYTES = 8
#: Names of the rows that are not fields: a sender's frames, and one of the times between them.
FRAMES, GAP = "", "gap"
KEY = ["capture_id", "w", "can_id"]


def _byte(payload: Column, i: int) -> Column:
    return hex_value(F.substring(payload, 2 * i + 1, 2))


def summed(placed: DataFrame, times: bool = True) -> DataFrame:
    """capture_id, w, can_id, field, gap_us, n, low, high, jump, least, first, opening, closing, id_t, id_line, from frames with w.

    A row for each window, sender and field: its values' extremes, largest step, the place of the first value (numbers of
    frame and field), and its first and last value. FRAMES rows count a sender's frames; least is the shortest gap. GAP rows
    count the gaps of each length, of which there may be as many as frames; without times they are left out, and only windows,
    senders and fields make rows. A field's value before a frame is that of the last frame long enough to have it.
    """
    order = Window.partitionBy(*KEY).orderBy("t_us", "line_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("payload") / 2
    own = placed.select(
        *KEY, "payload", F.floor(size).cast("int").alias("bytes"), F.row_number().over(order).cast("long").alias("number"), (F.col("t_us") - F.lag("t_us").over(order)).alias("gap"), F.first("t_us").over(order).alias("id_t"), F.first("line_no").over(order).alias("id_line"),
        *[F.last(F.when(size >= k, F.col("payload")), ignorenulls=True).over(before).alias(f"before{k}") for k in range(1, MOST_BYTES + 1)],
    )
    none, number = F.lit(None).cast("long"), F.col("number")

    def row(field: str, gap: Column, value: Column, step: Column, no: Column, there: Column) -> Column:
        return F.when(there, F.struct(F.lit(field).alias("field"), gap.alias("gap_us"), value.alias("value"), step.alias("step"), (number * 64 + no).alias("place")))

    rows = [row(FRAMES, none, none, F.col("gap"), F.lit(0), F.lit(True))]
    if times:
        rows.append(row(GAP, F.col("gap"), none, none, F.lit(0), F.col("gap").isNotNull()))
    n = F.col("bytes")
    for i in range(MOST_BYTES):
        now, last = _byte(F.col("payload"), i), _byte(F.col(f"before{i + 1}"), i)
        rows.append(row(f"byte{i}", none, now, F.abs(now - last), F.lit(i), n > i))
    for i in range(MOST_BYTES - 1):
        payload, last = F.col("payload"), F.col(f"before{i + 2}")
        for end, (a, b) in enumerate(((i, i + 1), (i + 1, i))):
            value = _byte(payload, a) * 256 + _byte(payload, b)
            rows.append(row(f"pair{i}_{('be', 'le')[end]}", none, value, F.abs(value - (_byte(last, a) * 256 + _byte(last, b))), n + 2 * i + end, n > i + 1))
    each = own.select(*KEY, "number", "id_t", "id_line", F.inline(F.array_compact(F.array(*rows))))
    code = number * 65536 + F.col("value")
    return each.groupBy(*KEY, "field", "gap_us").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.max("step").alias("jump"), F.min("step").alias("least"), F.min("place").alias("first"), F.min(code).alias("opening"), F.max(code).alias("closing"), F.min("id_t").alias("id_t"), F.min("id_line").alias("id_line"),
    )


def of_frames(frames: DataFrame, us: int, times: bool = True) -> DataFrame:
    """summed() of all windows of frames, the last ones too."""
    return summed(frames.withColumn("w", F.expr(f"t_us div {us}")), times)


def complete(sums: DataFrame, every: int = 1) -> DataFrame:
    """The rows of windows that are kept: all but each capture's last one, and each every-th only."""
    last = sums.where(F.col("field") == FRAMES).groupBy("capture_id").agg(F.max("w").alias("last_w"))
    return sums.join(last, "capture_id").where((F.col("w") < F.col("last_w")) & (F.col("w") % every == 0)).drop("last_w")


def spine(sums: DataFrame, us: int, every: int = 1) -> DataFrame:
    """windows.spine() from sums."""
    last = sums.where(F.col("field") == FRAMES).groupBy("capture_id").agg(F.max("w").alias("last_w")).where("last_w > 0")
    w = last.select("capture_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last_w") - 1)).alias("w")).where(F.col("w") % every == 0)
    return w.select("capture_id", "w", window_id(F.col("capture_id"), F.col("w")).alias("window_id"), (F.col("w") * us).alias("start_us"), ((F.col("w") + 1) * us).alias("end_us"))


def per_id(sums: DataFrame) -> DataFrame:
    """For each window and id: n, first (t_us and line_no of its first frame) and min_gap_us."""
    return sums.where(F.col("field") == FRAMES).select(*KEY, "n", F.struct(F.col("id_t").alias("t_us"), F.col("id_line").alias("line_no")).alias("first"), F.col("least").alias("min_gap_us"))


def gaps(sums: DataFrame) -> DataFrame:
    """(capture_id, w, can_id, gap_us, n): times between frames of an id inside windows, counted by length."""
    return sums.where(F.col("field") == GAP).select(*KEY, "gap_us", "n")


def per_field(sums: DataFrame) -> DataFrame:
    """For each window, id and field: n, low, high, jump (NULL of one value), first, opening, closing, id_t, id_line."""
    return sums.where(~F.col("field").isin(FRAMES, GAP)).select(*KEY, "field", "n", "low", "high", "jump", "first", "opening", "closing", "id_t", "id_line")


def ranges(sums: DataFrame) -> DataFrame:
    """For each capture, id and field over all its frames: low, high, jump. Steps inside windows are summed already; those
    from one window to the next that has the field go from its closing to its opening value."""
    fields = per_field(sums)
    by_field = Window.partitionBy("capture_id", "can_id", "field").orderBy("w")
    between = F.abs(F.col("opening") % 65536 - F.lag("closing").over(by_field) % 65536)
    every = fields.withColumn("between", between)
    return every.groupBy("capture_id", "can_id", "field").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.coalesce(F.greatest(F.max("jump"), F.max("between")), F.lit(0)).alias("jump"))
