import random

from tessel.llm import near_dup


def test_near_copies_in_a_bucket_make_few_rows(spark, monkeypatch):
    draw, size = random.Random(5), 300
    least = [1, 1 + size]
    sets = [draw.sample(range(1 << 30), 44)]
    for g in range(2):
        shared = draw.sample(range(1 << 30), 40)
        sets += [shared + draw.sample(range(1 << 30), 4) for _ in range(size)]
    # No copy is like the hub (0), so stars leave each on its own, and 90,000 pairs are links.
    table = spark.createDataFrame([(i, len(s), s) for i, s in enumerate(sets)], "doc_id long, n int, set array<int>")
    members = table.selectExpr("1L AS key", "doc_id")
    made, meet = [], near_dup.meet
    monkeypatch.setattr(near_dup, "meet", lambda *a, **k: made.append((out := near_dup.cut(meet(*a, **k))).count()) or out)
    got = {r["node"]: r["component"] for r in near_dup.link(members, table, 75, spark.createDataFrame([], "a long, b long"), by_bucket=True).collect()}
    assert got == {i: least[(i - 1) // size] for i in range(1, 2 * size + 1)}
    assert 0 < sum(made) <= 20 * len(sets)
