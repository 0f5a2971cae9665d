"""How many reference values lie below each value, by one range-partitioned merge of both; medians of many sets at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.operators.store import small, written


#: Leading binary digits by which each round of medians() tells values apart; the last round tells them all.
ROUNDS = (7, 14, 22, 63)


def counted(reference: DataFrame, by: list[str]) -> DataFrame:
    """(by, value, m): reference values, each distinct one once, with how often it occurs."""
    return reference.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("m"))


def below(values: DataFrame, reference: DataFrame, by: list[str]) -> DataFrame:
    """(by, value, below, n, most) for each distinct value of values (by, value): the references (by, value, m) of its group
    below it, their number in all, and the largest.

    Distinct values and references are sorted together into ranges, each range is counted by itself, and ranges are joined
    with the sums of those before them. No group is collected, and a group may span many ranges. A value whose group has
    no reference is left out.
    """
    points = values.select(*by, "value", F.lit(0).cast("long").alias("m")).union(reference.select(*by, "value", "m")).groupBy(*by, "value").agg(F.sum("m").alias("m"))
    placed = written(points.repartitionByRange(*by, "value").withColumn("part", F.spark_partition_id()), "ranks")
    parts = placed.groupBy(*by, "part").agg(F.sum("m").alias("m"), F.max(F.when(F.col("m") > 0, F.col("value"))).alias("top"))
    # A row for each group and range that it reaches into.
    of, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "part", F.coalesce(F.sum("m").over(order), F.lit(0)).alias("ahead"), F.sum("m").over(of).alias("n"), F.max("top").over(of).alias("most"))
    inside = F.coalesce(F.sum("m").over(Window.partitionBy(*by, "part").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted_ = placed.withColumn("inside", inside).join(small(parts, 128), [*by, "part"])
    return counted_.where("n > 0").select(*by, "value", (F.col("ahead") + F.col("inside")).alias("below"), "n", "most")


def unusualness(value: Column, below_: Column, n: Column, most: Column) -> Column:
    """Where a value stands among n reference values, in 0..1.

    Up to the largest: the share of values below it, of n + 1. Beyond: (n + 1 - 1 / (1 + (value - most) / s)) / (n + 1)
    with s = most, or 1 if that is 0.
    """
    scale = F.when(most > 0, most).otherwise(1.0)
    n = n.cast("double")
    return F.when(value <= most, below_.cast("double") / (n + 1)).otherwise((n + 1 - 1 / (1 + (value - most) / scale)) / (n + 1))


def scores(rows: DataFrame, reference: DataFrame, names: tuple[str, ...], by: list[str]) -> DataFrame:
    """rows with <name>_score for each check, its unusualness among reference (by, check, value, m). rows are read three
    times, so they should be a table; they are named by their columns by and window (capture_id, w)."""
    key = [*by, "capture_id", "w"]
    long = rows.select(*key, F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("value")) for c in names])))
    at = below(long.select(*by, "check", "value").distinct(), reference, [*by, "check"])
    score = unusualness(F.col("value"), F.col("below"), F.col("n"), F.col("most"))
    each = long.join(at, [*by, "check", "value"]).groupBy(*key).agg(*[F.max(F.when(F.col("check") == c, score)).alias(f"{c}_score") for c in names])
    return rows.join(each, key)


def leading(value: Column, digits: int) -> Column:
    """value (whole, 0 or more) with the binary digits behind its first ones set to 0; it never falls as value grows."""
    rest = F.greatest(F.length(F.bin(value)) - digits, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, rest), rest)


def medians(values: DataFrame, train: DataFrame, unit: str, key: str) -> DataFrame:
    """(model, key, median) of values (unit, key, value, n): of all units that train (model, unit) names for a model, the mean
    of the two middle values, as percentile() gives it.

    The middle ranks of all models close in together. A round counts each unit's values by some more of their leading
    digits, only where a rank still lies, and only these counts meet the models; values don't. values are read in each
    round, so they should be a table.
    """
    n = train.join(values.groupBy(unit, key).agg(F.sum("n").alias("n")), unit).groupBy("model", key).agg(F.sum("n").alias("n"))
    ranks = F.array_distinct(F.array(F.expr("(n - 1) div 2"), F.expr("n div 2")))
    want = n.select("model", key, F.explode(ranks).alias("rank")).select("*", F.col("rank").alias("rest"), F.lit(0).cast("long").alias("at"))
    known, one, before = small(train, 128), ["model", key, "rank", "rest"], 0
    for digits in ROUNDS:
        want = written(want, "middle-ranks")
        open_ = small(want.select(key, "at").distinct(), 64)
        inside = values.withColumn("at", leading(F.col("value"), before)).join(open_, [key, "at"])
        counts = inside.groupBy(unit, key, "at", leading(F.col("value"), digits).alias("next")).agg(F.sum("n").alias("n"))
        met = want.join(known, "model").join(counts, [unit, key, "at"]).groupBy(*one, "next").agg(F.sum("n").alias("n"))
        ahead = F.sum("n").over(Window.partitionBy(*one).orderBy("next")) - F.col("n")
        hit = met.withColumn("ahead", ahead).where("ahead <= rest and rest < ahead + n")
        want, before = hit.select("model", key, "rank", (F.col("rest") - F.col("ahead")).alias("rest"), F.col("next").alias("at")), digits
    return want.groupBy("model", key).agg((0.5 * F.min("at") + 0.5 * F.max("at")).alias("median"))
