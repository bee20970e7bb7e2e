import random

from pyspark.sql import functions as F

from tessel.llm import near_dup


def test_masks_rule_out_no_similar_pair(spark):
    draw = random.Random(9)
    sets = [draw.sample(range(-(1 << 31), 1 << 31), draw.randint(1, 300)) for _ in range(40)]
    sets += [[x for x in s if draw.random() < 0.8] + draw.sample(range(-(1 << 31), 1 << 31), 5) for s in sets]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, s array<int>").withColumn("m", near_dup.masked(F.col("s")))
    pairs = rows.alias("a").crossJoin(rows.alias("b")).select(F.col("a.i"), F.col("b.i"), near_dup.only_in(F.col("a.m"), F.col("b.m")))
    bounds = [(len(set(sets[i]) - set(sets[j])), n) for i, j, n in pairs.collect()]
    assert len(bounds) == 6400 and all(n <= true for true, n in bounds) and sum(n > 20 for _, n in bounds) > 100


def test_large_buckets_are_settled_exactly_with_few_rows(spark, monkeypatch):
    draw, n = random.Random(11), 700
    sets = [list(range(40)) + draw.sample(range(1000, 1 << 30), 20) for _ in range(n)]
    for i in range(0, n, 7):
        sets[i + 3] = sets[i][:-5] + draw.sample(range(1000, 1 << 30), 5)
    table = spark.createDataFrame([(i, len(s), s) for i, s in enumerate(sets)], "doc_id long, n int, set array<int>")
    members = table.selectExpr("1L AS key", "doc_id")
    written, cut = [], near_dup.cut
    monkeypatch.setattr(near_dup, "cut", lambda df: written.append(out := cut(df)) or out)
    monkeypatch.setattr(near_dup, "release", lambda *tables: None)
    got = {r["node"]: r["component"] for r in near_dup.link(members, table, 75, spark.createDataFrame([], "a long, b long"), by_bucket=True).collect()}
    assert got == {j: i for i in range(0, n, 7) for j in (i, i + 3)}
    rows = next(x for x in written if "sides" in x.columns)
    assert rows.agg(F.sum(F.when(F.col("component") != F.col("home"), F.col("blocks")).otherwise(0) + F.col("sides"))).first()[0] <= 6 * n
    monkeypatch.setattr(near_dup, "BUCKET_BLOCK", 50)
    again = {r["node"]: r["component"] for r in near_dup.link(members, table, 75, spark.createDataFrame([], "a long, b long"), by_bucket=True).collect()}
    assert again == got
