import random

from pyspark.sql import functions as F

from tessel.llm import near_dup


def test_masks_tell_long_sets_apart(spark):
    """Sets of 440 shingles, as many as a line of 450 characters has, share nothing: masks alone must say that they are not similar."""
    draw = random.Random(4)
    table = spark.createDataFrame([(i, draw.sample(range(-(1 << 31), 1 << 31), 440)) for i in range(12)], "doc_id long, set array<int>")
    both = near_dup.masks_of(table).join(table.withColumnRenamed("doc_id", "node"), "node").withColumn("single", near_dup.masked(F.col("set"))).cache()
    assert both.where("mask = single").count() == 12
    pairs = both.alias("a").join(both.alias("b"), F.expr("a.node <> b.node")).select(near_dup.only_in(F.col("a.mask"), F.col("b.mask")).alias("n"))
    assert pairs.count() == 132 and pairs.where("n <= 63").count() == 0


def test_rounds_read_the_sets_once(spark, monkeypatch):
    """A bucket of 300 is settled in three rounds; only the first may shuffle the table of all sets."""
    draw = random.Random(6)
    sets = [draw.sample(range(1 << 30), 44) for _ in range(300)]
    sets[290] = sets[10][:-3] + draw.sample(range(1 << 30), 3)
    table = spark.createDataFrame([(i, len(s), s) for i, s in enumerate(sets)], "doc_id long, n int, set array<int>")
    plans, cut = [], near_dup.cut
    monkeypatch.setattr(near_dup, "cut", lambda df: plans.append((df.columns, df._jdf.queryExecution().toString())) or cut(df))
    got = {r["node"]: r["component"] for r in near_dup.link(table.selectExpr("1L AS key", "doc_id"), table, 75, spark.createDataFrame([], "a long, b long"), by_bucket=True).collect()}
    assert got == {10: 10, 290: 10}
    wide = [plan for columns, plan in plans if "sides" in columns]
    # Only the table of all sets calls a line doc_id.
    assert len(wide) >= 3 and ["doc_id#" in plan for plan in wide] == [True] + [False] * (len(wide) - 1)
