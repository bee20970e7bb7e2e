"""Components of few edges are settled on the driver, and are the same as by rounds."""

import random

from tessel.llm.components import graph_components


def test_few_edges_take_few_jobs(spark):
    edges = spark.createDataFrame([(0, i, i + 1) for i in range(1, 300)], "g int, a long, b long")
    context = spark.sparkContext
    context.setJobGroup("few edges", "")
    try:
        got = {r["node"]: r["component"] for r in graph_components(edges).collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert got == dict.fromkeys(range(1, 301), 1)
    # Eight rounds and more, of several jobs each, were there for a chain of this length.
    assert len(context.statusTracker().getJobIdsForGroup("few edges")) <= 10


def test_driver_and_rounds_agree(spark):
    rng = random.Random(7)
    rows = [(g, rng.randrange(-40, 60) << 55, rng.randrange(-40, 60) << 55) for g in (0, 1) for _ in range(45)] + [(1, 5, 5), (0, 7, 9), (0, 9, 7), (1, 7, 8)]
    edges = spark.createDataFrame(rows, "g int, a long, b long")
    want = {}
    for g in (0, 1):
        near = {}
        for _, a, b in (r for r in rows if r[0] == g and r[1] != r[2]):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        for n in near:
            seen, new = {n}, [n]
            while new:
                new = [y for y in near[new.pop()] if y not in seen] + new
                seen |= set(new)
            want[g, n] = min(seen)
    for few in (0, 1 << 17):
        table = graph_components(edges, few)
        assert table.dtypes == [("g", "int"), ("node", "bigint"), ("component", "bigint")]
        got = sorted((r["g"], r["node"], r["component"]) for r in table.collect())
        assert got == sorted((g, n, c) for (g, n), c in want.items())
    assert graph_components(edges.limit(0)).count() == 0
