"""Where a regular expression matches in a text, in DataFrame expressions whose cost is linear in the text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _indexes(n: Column) -> Column:
    """0 to n - 1 as an array, empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _blocks(a: Column, n: Column) -> Column:
    return F.transform(_indexes(F.ceil(n / _BLOCK).cast("int")), lambda b: F.slice(a, b * _BLOCK + 1, F.lit(_BLOCK)))


def sums_before(a: Column, levels: int = 3) -> Column:
    """For each place of an array of int the sum of all before it.

    Sums go by blocks of 256, and over blocks of blocks, so each place adds a bounded number of values at each level.
    """

    def within(block: Column, start: Column) -> Column:
        return F.transform(block, lambda x, i: start + _sum(F.slice(block, F.lit(1), i)))

    if levels == 1:
        return within(a, F.lit(0))

    def by_blocks(parts: Column) -> Column:
        starts = sums_before(F.transform(parts, _sum), levels - 1)
        return F.flatten(F.zip_with(parts, starts, within))

    return let(_blocks(a, F.size(a)), by_blocks)


def running_max(a: Column) -> Column:
    """For each place of an array of int (none below -1) the largest up to it, in steps that double how far back they look."""
    steps = F.filter(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.pow(F.lit(2), k).cast("int")), lambda s: s < F.size(a))
    return F.aggregate(steps, a, lambda own, s: F.slice(F.zip_with(own, F.concat(F.array_repeat(F.lit(-1), s), own), lambda x, y: F.greatest(x, y)), F.lit(1), F.size(own)))


def matches(text: Column, regex: Column) -> Column:
    """The matches in a text from left to right, as structs: first, last (code points, last exclusive), value, before and
    after (what lies between the match and its neighbours, or the text's ends).

    The lengths of what lies between the matches, and of the matches, tell where each one is.
    """
    both = F.struct(F.regexp_extract_all(text, regex, F.lit(0)).alias("hits"), F.split(text, regex, -1).alias("gaps"))

    def placed(s: Column) -> Column:
        steps = F.transform(s["hits"], lambda h, i: F.length(h) + F.length(F.get(s["gaps"], i)))
        ends = F.arrays_zip(sums_before(steps).alias("at"), s["hits"].alias("hit"))

        def one(x: Column, i: Column) -> Column:
            gap = F.get(s["gaps"], i)
            first = x["at"] + F.length(gap)
            return F.struct(first.alias("first"), (first + F.length(x["hit"])).alias("last"), x["hit"].alias("value"), gap.alias("before"), F.get(s["gaps"], i + 1).alias("after"))

        return F.transform(ends, one)

    return let(both, placed)
