"""The quantiles in use, each by its own definition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def interpolated(x: Column, p: float) -> Column:
    """Linear between the closest ranks (type 7)."""
    return F.percentile(x, p)


def _at_rank(df: DataFrame, by: list[str], value: str, rank: Column, name: str) -> DataFrame:
    """For each group the value whose place in ascending order, from 0, is rank, an expression of the group's n.

    Values are counted first, so ties cost nothing; distinct ones are merged in ranges, so neither a group nor all rows
    together are one task's work.
    """
    from tracewright.operators import ranks
    from tracewright.operators.store import written

    keys = by or ["every"]
    own = df.where(F.col(value).isNotNull()).select(*[F.lit(0).alias("every")] * (not by), *by, F.col(value).cast("double").alias("value"))
    counted = written(ranks.counted(own, keys), "quantile")
    at = ranks.below(counted.select(*keys, "value"), counted, keys).join(counted, [*keys, "value"])
    return at.where((F.col("below") <= rank) & (rank < F.col("below") + F.col("m"))).select(*by, F.col("value").alias(name))


def nearest_rank_p95(df: DataFrame, by: list[str], value: str, name: str = "p95") -> DataFrame:
    """The value at rank round(0.95 (n - 1)), halves to even."""
    return _at_rank(df, by, value, F.bround(F.lit(0.95).cast("double") * (F.col("n") - 1)), name)


def floor_index_p95(df: DataFrame, by: list[str], value: str, name: str = "p95") -> DataFrame:
    """The value at index floor(0.95 n), the last one at most."""
    return _at_rank(df, by, value, F.least(F.col("n") - 1, F.floor(F.lit(0.95).cast("double") * F.col("n"))), name)
