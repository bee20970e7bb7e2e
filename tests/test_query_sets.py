import random

import pytest
from pyspark.sql import functions as F

from tessel.functions.metrics import Metric
from tessel.operators import index
from tessel.plans.catalogue import QUERIES, asked_of, embeddings


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    draw, path = random.Random(2), str(tmp_path_factory.mktemp("sf"))
    rows = [(i, [draw.gauss(0, 1) for _ in range(64)], i % 4) for i in range(130)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


def hits(rows):
    return sorted((r["qid"], r["rank"], r["id"]) for r in rows.collect())


def test_approximate_searches_ask_every_twentieth_row(spark, sf_dir):
    asked = set(range(0, 130, 20))
    assert {q for q, _, _ in hits(QUERIES["hnsw_default_beam"](spark, sf_dir))} == asked
    for m in Metric:
        assert hits(QUERIES[f"hnsw_full_beam_all_{m.value}"](spark, sf_dir)) == hits(QUERIES[f"knn_join_{m.value}"](spark, sf_dir))
    assert {q for q, _, _ in hits(QUERIES["hnsw_incremental_full_beam_all"](spark, sf_dir))} == asked
    assert [r["ok"] for r in QUERIES["hnsw_recall_ok"](spark, sf_dir).collect()] == [True]


def test_blocks_of_queries(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    nodes = index.build(rows, Metric.COSINE, 64, 2)
    one, three = (hits(index.search_table(nodes, asked_of(rows), 10, 64, Metric.COSINE, 64, block=n)) for n in (1000, 3))
    assert one == three and len(one) == 70
    assert hits(index.search_table(nodes, asked_of(rows).limit(0), 10, 64, Metric.COSINE, 64)) == []


def test_pairwise_metrics_of_the_stated_rows_with_all(spark, sf_dir):
    got = [(r["a"], r["b"]) for r in QUERIES["pairwise_metrics_all"](spark, sf_dir).select("a", "b").collect()]
    assert sorted(got) == [(a, b) for a in range(0, 130, 20) for b in range(130)]


def test_many_queries_and_all_pairs_go_by_blocks(spark, sf_dir):
    from tessel.operators import exact

    plan = lambda df: df._jdf.queryExecution().toString()
    rows = embeddings(spark, sf_dir)
    queries = rows.selectExpr("id AS qid", "vector AS query")
    few, many = (exact.knn_join(queries.where(f"qid < {n}"), rows, 3, Metric.EUCLIDEAN) for n in (9, 130))
    assert "MapInArrow" not in plan(few) and "MapInArrow" in plan(many)
    assert hits(many)[:27] == hits(few)
    got = QUERIES["pairwise_metrics_all"](spark, sf_dir)
    assert "MapInArrow" in plan(got)
    for m in Metric:
        want = rows.where("id % 20 = 0").selectExpr("id AS a", "vector AS x").crossJoin(rows.selectExpr("id AS b", "vector AS y")).withColumn("s", m.score(F.col("x"), F.col("y")))
        scores = {(r["a"], r["b"]): r["s"] for r in want.select("a", "b", "s").collect()}
        found = {(r["a"], r["b"]): r[m.value] for r in exact.pairwise_scores(rows.where("id % 20 = 0"), rows, [m]).collect()}
        assert found == scores
