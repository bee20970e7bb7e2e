import hashlib
import os

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessel.errors import InvalidInput
from tessel.functions import passages
from tessel.operators import evaluate, keyword
from tessel.sources import jsonl, markdown


def test_bm25_filter_and_sources(spark):
    rows = [(0, "water the ferns", "garden/ferns.md", ["garden"]), (1, "water the ferns twice", "garden/ferns.md", ["garden"]), (2, "water ferns ferns ferns", "shed/tools.md", ["shed"]), (3, "prune a rose", "garden/rose.md", ["garden"])]
    table = spark.createDataFrame(rows, "id bigint, text string, source string, tags array<string>")
    names = lambda q, tag: [r[0] for r in keyword.sources(table, q, tag=tag).collect()]
    assert names("water ferns", "garden") == ["garden/ferns.md"]
    assert names("unknownword", None) == [] and names("water", "absent") == [] and names("", None) == []


@pytest.mark.parametrize("n", [0, 1, 320, 321, 592, 593])
def test_windows(spark, n):
    got = [tuple(x) for x in spark.range(1).select(passages.windows(F.array_repeat(F.lit("w"), n), 320, 48)).first()[0]]
    want, start = [], 0
    while n and (not want or want[-1][2] < n):
        want.append((len(want), start, min(start + 320, n)))
        start += 272
    assert got == want


def test_title_and_snippet(spark):
    rows = spark.createDataFrame([("x\n# Head \ny", "stem"), ("## no", "stem"), ("", "stem")], "t string, f string")
    assert [r[0] for r in rows.select(passages.title(F.col("t"), F.col("f"))).collect()] == ["Head ", "stem", "stem"]
    assert spark.createDataFrame([("😀" * 300,)], "t string").select(F.length(passages.snippet(F.col("t")))).first()[0] == 240


def test_notes_of_a_folder(spark, tmp_path):
    for d in ("plants/a [b]", ".hidden", "dist", "x/node_modules", "Secure", "_drafts"):
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "leaf+é.MD").write_text(f"# {d}\ngreen")
    (tmp_path / "plan.txt").write_text("x")
    (tmp_path / ".secret.md").write_text("x")
    os.symlink(tmp_path / "plants/a [b]/leaf+é.MD", tmp_path / "linked.md")
    os.symlink(tmp_path / "plants", tmp_path / "behind")
    rows = {r["source"]: r["text"] for r in markdown.read_notes(spark, {"n": tmp_path}).collect()}
    assert rows == {"n/plants/a [b]/leaf+é.MD": "# plants/a [b]\ngreen", "n/_drafts/leaf+é.MD": "# _drafts\ngreen"}
    (one,) = markdown.read_notes(spark, {"y": tmp_path / "_drafts/leaf+é.MD"}).collect()
    assert one["source"] == "y/leaf+é.MD" and one["sha256"] == hashlib.sha256("# _drafts\ngreen".encode()).hexdigest()
    assert markdown.read_notes(spark, {"x": tmp_path / "plan.txt"}).count() == 0


def test_percentiles_of_large_groups(spark):
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 2), ("c", 5000)) for v in range(n)] + [("d", 7.0)] * 3000 + [("d", None), (None, 3.0), (None, 4.0), (None, 9.0)]
    table = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["p50"], r["p95"]) for r in evaluate.nearest_ranks(table, "g", "v", {"p50": 0.5, "p95": 0.95}, groups=16).collect()}
    want = {}
    for g in ("a", "b", "c", "d", None):
        own = sorted(v for k, v in rows if k == g and v is not None)
        want[g] = tuple(own[int((len(own) - 1) * p + 0.5)] for p in (0.5, 0.95))
    assert got == want


def test_jsonl(spark, tmp_path):
    good = tmp_path / "q.jsonl"
    good.write_text('{"text":"é","vector":[1.0],"model":"m"}\n\n  \n')
    (row,) = jsonl.read_queries(spark, f"file://{good}").collect()
    assert row["relevant_paths"] == [] and row["filter_tag"] is None
    good.write_text("{oops\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        jsonl.read_queries(spark, f"file://{good}").collect()
    with pytest.raises(InvalidInput):
        jsonl.write_jsonl(spark.createDataFrame([([float("nan")],)], "vector array<float>"), f"file://{tmp_path}/out")


def test_measures(spark):
    hits = spark.createDataFrame([(0, i, 0.0, i) for i in range(1, 11)] + [(1, i, 0.0, i) for i in range(1, 4)], "qid bigint, id bigint, score float, rank int")
    assert evaluate.recall(hits.where("id <> 3"), hits).first()[0] == pytest.approx(11 / 13)
    assert evaluate.recall(hits.limit(0), hits.limit(0)).first()[0] is None
    found = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (1, 1, "c")], "qid bigint, position int, source string")
    relevant = spark.createDataFrame([(0, "b"), (0, "z"), (1, "q")], "qid bigint, source string")
    assert tuple(evaluate.hit_rate(found, relevant).first()) == (0.5, 0.25)
    assert tuple(evaluate.hit_rate(found, relevant.limit(0)).first()) == (None, None)
    assert spark.range(1, 5).agg(evaluate.nearest_rank("id", 0.5)).first()[0] == 3


def test_documents_skip_hits_without_a_source(spark):
    hits = spark.createDataFrame([(0, i, 0.5, i + 1) for i in range(6)], "qid bigint, id bigint, score float, rank int")
    meta = spark.createDataFrame([(0, "null"), (1, '{"source":1}'), (2, '{"source":"a","text":"x"}'), (3, '{"source":"a"}'), (4, '{"source":"b"}'), (5, None)], "id bigint, metadata string")
    assert [(r["position"], r["source"]) for r in evaluate.documents(hits, meta).orderBy("position").collect()] == [(1, "a"), (2, "b")]


def test_ranks_do_not_depend_on_the_order_of_rows(spark):
    # Each reading of the rows comes in another order, as from several executors.
    def shuffled(batches):
        import numpy as np

        for b in batches:
            yield b.sample(frac=1, random_state=np.random.default_rng())

    values = spark.range(150_000, numPartitions=3).selectExpr("CAST(id % 2 AS STRING) AS g", "(id * 7919 % 150001) / 16 AS v").mapInPandas(shuffled, "g string, v double")
    plan = evaluate.nearest_ranks(values, "g", "v", {"p50": 0.5}, groups=64)
    for g, p50 in (sorted(tuple(r) for r in plan.collect())):
        want = sorted((i * 7919 % 150001) / 16 for i in range(int(g), 150_000, 2))
        assert p50 == want[37_500]
    assert "percentile_approx" not in plan._jdf.queryExecution().executedPlan().toString()
