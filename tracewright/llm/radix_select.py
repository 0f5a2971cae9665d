"""The k rows of every group with the highest values, by distributed histograms instead of sorting groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.llm.common import cut, small

#: Bits of a value, and bytes of an item, that one round of histograms tells apart.
BITS, BYTES = 16, 2


def _width(keys: list[str]) -> Column:
    return sum((F.coalesce(F.length(k), F.lit(0)) for k in keys), F.lit(128))


def _within(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(small(state, _width(keys)), keys)


def _hit(histogram: DataFrame, keys: list[str], order: Column, need: Column) -> DataFrame:
    """The bin of each group that holds its need-th row, with need as counted inside it (need) and the bin's rows (m)."""
    # A group's histogram has at most 2^16 bins, however many rows it has.
    upto = F.sum("m").over(Window.partitionBy(*keys).orderBy(order))
    return histogram.withColumn("upto", upto).where((F.col("upto") - F.col("m") < need) & (need <= F.col("upto"))).withColumn("need", need - (F.col("upto") - F.col("m"))).drop("upto")


def thresholds(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(keys, bound, need) of the groups with k rows or more: the k-th highest value, and how many of the rows that have it
    are among the k. Each of four rounds counts rows by 16 more bits of the value (long, 0 or more)."""
    state = None
    for shift in range(64 - BITS, -1, -BITS):
        bits = F.shiftright("value", shift).alias("bound")
        if state is None:
            found = _hit(rows.groupBy(*keys, bits).agg(F.count(F.lit(1)).alias("m")), keys, F.desc("bound"), F.lit(k).cast("long"))
        else:
            own = _within(rows, state.withColumnRenamed("bound", "above"), keys).where(F.shiftright("value", shift + BITS) == F.col("above"))
            found = _hit(own.groupBy(*keys, "need", bits).agg(F.count(F.lit(1)).alias("m")), keys, F.desc("bound"), F.col("need"))
        state = cut(found.select(*keys, "bound", "need"), "radix")
    return state


def _common(a: Column, b: Column) -> Column:
    """The bytes that two binary values begin with alike."""
    n = F.least(F.octet_length(a), F.octet_length(b))
    differ = F.array_position(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), False)
    return F.when(n == 0, F.substring(a, 1, 0)).otherwise(F.substring(a, F.lit(1), F.when(differ > 0, differ.cast("int") - 1).otherwise(n)))


def tie_bounds(rows: DataFrame, keys: list[str], state: DataFrame) -> DataFrame:
    """(keys, bound, last): the last item, in the order of UTF-8 bytes, that is taken among the rows whose value is the bound.

    Each round skips what a group's tied items begin with alike and counts them by the two bytes behind it, so even long
    items with long common beginnings take a few rounds.
    """
    item = F.col("item").cast("binary")
    begins = lambda text: F.substring(text, F.lit(1), F.octet_length("begin")) == F.col("begin")
    tied = cut(_within(rows.select(*keys, "value", "item"), state.select(*keys, "bound"), keys).where("value = bound").select(*keys, item.alias("item")), "radix-ties")
    open_ = state.select(*keys, "bound", "need", F.lit("").cast("binary").alias("begin"))
    done: DataFrame | None = None
    while True:
        own = _within(tied, open_, keys).where(begins(F.col("item")))
        seen = cut(own.groupBy(*keys, "bound", "need").agg(F.count(F.lit(1)).alias("m"), F.min("item").alias("low"), F.max("item").alias("last")), "radix-tied")
        closed = seen.where("m = need or low = last").select(*keys, "bound", "last")
        done = closed if done is None else done.union(closed)
        rest = seen.where("m <> need and low <> last").select(*keys, "bound", "need", _common(F.col("low"), F.col("last")).alias("begin"))
        if rest.isEmpty():
            return done.withColumn("last", F.col("last").cast("string"))
        own = _within(tied, rest, keys).where(begins(F.col("item")))
        more = F.substring(F.col("item"), F.octet_length("begin") + 1, F.lit(BYTES)).alias("more")
        found = cut(_hit(own.groupBy(*keys, "bound", "need", "begin", more).agg(F.count(F.lit(1)).alias("m")), keys, F.asc("more"), F.col("need")), "radix-begin")
        ended = F.octet_length("more") < BYTES
        at = F.concat("begin", "more")
        done = done.union(found.where(ended).select(*keys, "bound", at.alias("last")))
        open_ = found.where(~ended).select(*keys, "bound", "need", at.alias("begin"))


def top(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """rows (keys, value, item) with rank, from 1 by value descending and item ascending (UTF-8 bytes), only ranks to k.

    keys are not null. Groups with fewer rows are whole. Of equal items as many as fit are taken. No rows give no rows.
    """
    bounds = tie_bounds(rows, keys, thresholds(rows, keys, k)).withColumnRenamed("bound", "least")
    marked = rows.join(small(bounds, _width(keys) + F.length("last")), keys, "left")
    kept = marked.where("least is null or value > least or (value = least and item <= last)").drop("least", "last")
    # At most k rows of a group are left, and copies of its last item.
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("value"), "item"))).where(F.col("rank") <= k)
