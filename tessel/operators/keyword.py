"""BM25 keyword ranking over a table of passages."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def tokens(text):
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def words_of(query: str) -> list[str]:
    """The distinct tokens of a query, in order."""
    return list(dict.fromkeys(re.findall("[a-z0-9]+", query.lower())))


def scores(passages: DataFrame, query: str, *, tag: str | None = None) -> DataFrame:
    """passages (id, text, source, tags) of the tag with their score above zero. Statistics are those of the passages of the tag.

    Each pass over the texts finds a passage's length and the counts of the query's words by expressions over the text itself, without an array of its tokens: the first
    gathers the statistics (a single row), the second scores. No passage is shuffled.
    """
    eligible = passages if tag is None else passages.where(F.array_contains("tags", tag))
    wanted = words_of(query)
    low = F.lower("text")
    # A token is a maximal run, so a word is one if neither neighbour belongs to the run.
    count = lambda w: F.regexp_count(low, F.lit(f"(?<![a-z0-9]){w}(?![a-z0-9])"))
    sized = eligible.withColumns({"_n": F.regexp_count(low, F.lit("[a-z0-9]+")), **{f"_f{i}": F.when(F.contains(low, F.lit(w)), count(w)).otherwise(0) for i, w in enumerate(wanted)}})
    found = sized.agg(F.count(F.lit(1)).alias("docs"), F.avg("_n").alias("avg"), *(F.count(F.when(F.col(f"_f{i}") > 0, 1)).alias(f"df{i}") for i in range(len(wanted)))).first()
    total = F.lit(0.0)
    for i in range(len(wanted)):
        f, df = F.col(f"_f{i}"), found[f"df{i}"]
        norm = f + K1 * ((1 - B) + B * F.col("_n") / F.lit(found["avg"] or 1.0))
        total = total + F.when(f > 0, F.lit(math.log(1.0 + (found["docs"] - df + 0.5) / (df + 0.5))) * f * (K1 + 1) / norm).otherwise(0.0)
    return sized.withColumn("score", total).where("score > 0").select(*passages.columns, "score")


def sources(passages: DataFrame, query: str, *, tag: str | None = None, limit: int = 5) -> DataFrame:
    """(source, score): the best passage of each source, best sources first, ties by name."""
    best = scores(passages, query, tag=tag).groupBy("source").agg(F.max("score").alias("score"))
    return best.orderBy(F.col("score").desc(), "source").limit(limit)
