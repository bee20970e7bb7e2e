"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled queue. A document's virtual finish time is the words of its source up to and with it,
divided by the source's target; a second and third round through the queue follow on. All queues are merged by finish time and
cut where the budget is spent: at time 1 every source has given its target.

Running sums are two-level, so no source is ever in one task: a queue is cut into about sqrt(rows) ranges, the ranges' sums
are added up, and only the rows of one range are added one by one. The merge is done alike: slices of finish time are summed,
the slice in which the budget ends is found, and only its rows are sorted. All sums are of whole numbers, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tessel.llm.shared import cut, named, release

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_ROUNDS = 3
#: Finish times from here on share a slice.
LAST_SLICE = 4.0


def targets(sources: DataFrame, weights: tuple[int, ...], rounds: int) -> DataFrame:
    """(source, source_size) with target: shares of the total by weight, none above rounds * source_size.

    With the sources in order of capacity per weight, those filled to capacity come first; the rest share what is left.
    The table has a row for each source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(order) - 1) % len(weights)
    known = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), at.cast("int") + 1))
    known = known.withColumn("cap", rounds * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    known = known.withColumn("level", (F.sum("source_size").over(W.partitionBy(F.lit(1))) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest))
    # The first source that isn't filled sets the level.
    first = F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(W.partitionBy(F.lit(1)))
    return known.withColumn("share", first["level"]).select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("share") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, *, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, rounds: int = MAX_ROUNDS, seed: str = "mix", keep_text: bool = False) -> DataFrame:
    """docs (without text unless keep_text) with size, source_size, target and taken (words the mix takes of it, repeats counted); a row for each row of docs.

    Sources by code point (null last) weigh ``weights`` in turn and share all words; no document is taken more than ``rounds``
    times. Null and empty texts have size 0 and are taken 0 times; a text of any length is counted whole. Documents whose keys are equal, repeated rows and null keys
    among them, queue one behind the other by size. An empty table gives an empty one. A column of docs that has one of the four names is returned
    as ``<name>_of_document``; all others keep theirs.
    """
    new = ("size", "source_size", "target", "taken")
    size = F.coalesce(F.regexp_count(named(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))
    shuffled = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(named(key).cast("string"), F.lit("")))), 1, 12), 16, 10).cast("long")
    kept = [c for c in docs.columns if keep_text or c != text]
    queued = cut(docs.select(F.struct(*map(named, kept)).alias("_doc"), named(source).alias("_s"), size.alias("_size"), shuffled.alias("_k")))
    out = _queued(queued, weights, rounds)
    back = [F.col("_doc")[c].alias(f"{c}_of_document" if c in new else c) for c in kept]
    return out.select(*back, *(F.col(f"_{c}").alias(c) for c in new))


def _queued(queued: DataFrame, weights: tuple[int, ...], rounds: int) -> DataFrame:
    """queued (_doc, _s, _size, _k) with _source_size, _target and _taken."""
    n = max(1, math.isqrt(queued.count()))
    ranged = queued.withColumn("_range", F.floor(F.col("_k") * (n / float(1 << 48))))
    sums = cut(ranged.groupBy(F.col("_s").alias("source"), "_range").agg(F.sum("_size").alias("n")))
    goals = targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")), weights, rounds)
    before = F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("_before", before).join(goals.withColumnRenamed("source", "_g"), F.col("source").eqNullSafe(F.col("_g"))).drop("_g", "n")
    starts = starts.select(F.col("source").alias("_source"), F.col("_range").alias("_r"), "_before", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    within = F.sum("_size").over(W.partitionBy("_s", "_range").orderBy("_k", "_size").rowsBetween(W.unboundedPreceding, 0))
    items = ranged.withColumn("_cum", within).join(starts, F.col("_s").eqNullSafe(F.col("_source")) & (F.col("_range") == F.col("_r")))
    items = cut(items.select("_doc", "_size", (F.col("_cum") + F.col("_before")).alias("_cum"), "_source_size", "_target"))
    release(queued, sums)
    finish = [(F.lit(r) * F.col("_source_size") + F.col("_cum")) / F.col("_target") for r in range(rounds)]
    end = _end(items.where("_size > 0").select(F.col("_size").alias("size"), F.explode(F.array(*finish)).alias("finish")), items, n)
    taken = sum((F.when(f < F.lit(end), 1).otherwise(0) for f in finish[1:]), F.when(finish[0] < F.lit(end), 1).otherwise(0))
    return items.withColumn("_taken", F.when(F.col("_size") > 0, F.col("_size") * taken).otherwise(F.lit(0)).cast("long"))


def _end(times: DataFrame, items: DataFrame, n: int) -> float:
    """The least finish time at which the merged queues exceed all words; documents that finish before it are taken."""
    budget = items.agg(F.sum("_size")).first()[0] or 0
    times = times.withColumn("slice", F.floor(F.least(F.col("finish"), F.lit(LAST_SLICE)) * n))
    slices = times.groupBy("slice").agg(F.sum("size").alias("n"))
    run = F.sum("n").over(W.orderBy("slice"))
    found = slices.withColumn("run", run).where(F.col("run") > budget).orderBy("slice").select("slice", F.col("run") - F.col("n")).first()
    if found is None:
        return math.inf
    rows = times.where(F.col("slice") == found[0]).groupBy("finish").agg(F.sum("size").alias("n"))
    return rows.withColumn("run", F.sum("n").over(W.orderBy("finish")) + found[1]).where(F.col("run") > budget).agg(F.min("finish")).first()[0]
