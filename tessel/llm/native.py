"""Expressions that Spark lacks, out of those that it has."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(x: Column, then) -> Column:
    """then(x), with x evaluated once, even where then() names it in a lambda."""
    return F.transform(F.array(x), then)[0]


def offsets(sizes: Column) -> Column:
    """For each of an array of ints the sum of those before it.

    An array that grows by one element is copied each time, so sums are taken in blocks of about the root of the array's size, and the blocks are joined:
    n sizes cost n to the power of 1.5, not n squared.
    """
    none = F.array().cast("array<int>")
    start = lambda at: F.struct(at.cast("int").alias("at"), none.alias("all"))

    def whole(xs: Column) -> Column:
        step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(xs))).cast("int"))

        def block(s: Column, i: Column) -> Column:
            inner = F.aggregate(F.slice(xs, i + 1, step), start(s["at"]), lambda t, x: F.struct((t["at"] + x).cast("int").alias("at"), F.concat(t["all"], F.array(t["at"])).alias("all")))
            return bound(inner, lambda r: F.struct(r["at"].cast("int").alias("at"), F.concat(s["all"], r["all"]).alias("all")))

        return F.aggregate(F.sequence(F.lit(0), F.size(xs) - 1, step), start(F.lit(0)), block, lambda s: s["all"])

    return F.when(F.size(sizes) > 0, bound(sizes, whole)).otherwise(none)
