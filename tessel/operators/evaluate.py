"""Measures of retrieval: recall, hit rate, reciprocal rank, nearest-rank percentiles, and hits by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def recall(approximate: DataFrame, exact: DataFrame, k: int = 10) -> DataFrame:
    """One row (recall): hits of the exact best k that the approximate best k have, over all queries; null without any."""
    want = exact.where(F.col("rank") <= k).select("qid", "id")
    got = approximate.where(F.col("rank") <= k).select("qid", "id").withColumn("hit", F.lit(1))
    both = want.join(got, ["qid", "id"], "left")
    return both.agg((F.count("hit") / F.nullif(F.count(F.lit(1)), F.lit(0).cast("long"))).alias("recall"))


def documents(hits: DataFrame, metadata: DataFrame, *, limit: int = 5, snippet: int = 240) -> DataFrame:
    """(qid, position, source, title, score, snippet): the first hit of each source in rank order; hits without a string source are skipped.

    hits have qid, id, score and rank; metadata has id and metadata (JSON text).
    """
    field = lambda k: F.try_variant_get(F.try_parse_json("metadata"), f"$.{k}", "string")
    text = F.schema_of_variant(F.try_variant_get(F.try_parse_json("metadata"), "$.source", "variant")) == "STRING"
    named = hits.join(metadata.select("id", "metadata"), "id").where(text).select("qid", "rank", "score", field("source").alias("source"), field("title").alias("title"), F.substring(field("text"), 1, snippet).alias("snippet"))
    first = named.withColumn("_n", F.row_number().over(W.partitionBy("qid", "source").orderBy("rank"))).where("_n = 1")
    placed = first.withColumn("position", F.row_number().over(W.partitionBy("qid").orderBy("rank")))
    return placed.where(F.col("position") <= limit).select("qid", "position", "source", "title", "score", "snippet")


def first_relevant(found: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """(qid, position): where in its best k documents a labelled query finds the first relevant source; null if nowhere."""
    hits = found.where(F.col("position") <= k).join(relevant.select("qid", "source").distinct(), ["qid", "source"]).groupBy("qid").agg(F.min("position").alias("position"))
    return relevant.select("qid").distinct().join(hits, "qid", "left")


def hit_rate(found: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """One row (hit_rate, mrr) over labelled queries; nulls without any."""
    return first_relevant(found, relevant, k).agg(F.avg(F.when(F.col("position").isNotNull(), 1.0).otherwise(0.0)).alias("hit_rate"), F.avg(F.coalesce(1.0 / F.col("position"), F.lit(0.0))).alias("mrr"))


def nearest_rank(x: str | Column, p: float) -> Column:
    """Aggregate: the value at place round((n - 1) * p), half away from zero, of the sorted values; for groups that fit a task. Of others nearest_ranks() has it."""
    return F.element_at(F.sort_array(F.collect_list(x)), F.round((F.count(x) - 1) * p).cast("int") + 1)


def nearest_ranks(rows: DataFrame, by: str, value: str, ps: dict[str, float], groups: int = 1024) -> DataFrame:
    """(by, *names): for each group and each name's p the value at place round((n - 1) * p), half away from zero, of the group's sorted values; nulls aren't counted.

    No group is held in one place: equal values are counted first, a group's distinct values are cut into about ``groups`` ranges, the ranges' counts are summed up, and only
    the range in which a place falls is ranked. The cuts are the values of the least hashes: the plan reads them twice, so they must not depend on the order in which rows come,
    as those of an approximate percentile do.
    """
    counted = rows.select(F.col(by).alias("g"), F.col(value).alias("v")).where("v IS NOT NULL").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    sample = counted.withColumn("_n", F.row_number().over(W.partitionBy("g").orderBy(F.xxhash64("v"), "v"))).where(F.col("_n") < groups)
    cuts = sample.groupBy(F.col("g").alias("cut_g")).agg(F.sort_array(F.collect_list("v")).alias("cuts"))
    sizes = counted.groupBy(F.col("g").alias("all_g")).agg(F.sum("n").alias("all"))
    cuts = cuts.join(sizes, F.col("cut_g").eqNullSafe(F.col("all_g"))).drop("all_g")
    # A value's range is the number of cuts below it, by bisection.
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(groups.bit_length()))))
    below = F.aggregate(steps, F.lit(0), lambda at, x: F.when(F.try_element_at("cuts", at + x) < F.col("v"), at + x).otherwise(at))
    placed = counted.join(cuts, F.col("g").eqNullSafe(F.col("cut_g"))).select("g", "v", "n", "all", below.alias("range"))
    sums = placed.groupBy("g", "range", "all").agg(F.sum("n").alias("sum"))
    sums = sums.withColumn("before", F.coalesce(F.sum("sum").over(W.partitionBy("g").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    places = F.explode(F.array(*(F.struct(F.lit(k).alias("name"), (F.round((F.col("all") - 1) * p) + 1).cast("long").alias("place")) for k, p in ps.items())))
    asked = sums.select(F.col("g").alias("in_g"), F.col("range").alias("in_range"), "before", "sum", places.alias("p")).where("p.place > before AND p.place <= before + sum").select("in_g", "in_range", "before", "p.*")
    ranged = placed.join(asked.select("in_g", "in_range", "before").distinct(), F.col("g").eqNullSafe(F.col("in_g")) & (F.col("range") == F.col("in_range"))).select("g", "range", "v", "n", "before")
    ranged = ranged.select("g", "range", "v", "n", (F.sum("n").over(W.partitionBy("g", "range").orderBy("v")) + F.col("before")).alias("to"))
    found = asked.drop("before").join(ranged, F.col("g").eqNullSafe(F.col("in_g")) & (F.col("range") == F.col("in_range")) & (F.col("place") <= F.col("to")) & (F.col("place") > F.col("to") - F.col("n")))
    return found.groupBy(F.col("in_g").alias(by)).agg(*(F.max(F.when(F.col("name") == k, F.col("v"))).alias(k) for k in ps))


def mismatched_models(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """(model): models of queries that no row has."""
    return queries.select("model").distinct().join(rows.select("model").distinct(), "model", "left_anti")


def missing_labels(queries: DataFrame, sources: DataFrame) -> DataFrame:
    """(qid, source): relevant paths that are no known source."""
    asked = queries.select("qid", F.explode("relevant_paths").alias("source"))
    return asked.join(sources.select("source").distinct(), "source", "left_anti").select("qid", "source")
