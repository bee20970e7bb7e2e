"""Every stage of the pipeline, and the operators behind them, on nulls, blanks, repeated rows, long texts, clashing names and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessel.llm.decontaminate import decontaminate
from tessel.llm.line_dedup import line_dedup
from tessel.llm.mixing import mix
from tessel.llm.near_dup import near_duplicates
from tessel.llm.phrase_dedup import remove_repeats
from tessel.llm.pii import pii_report
from tessel.llm.repetition import repetition
from tessel.llm.secrets import secret_report
from tessel.llm.toxicity import toxicity
from tests.llm import brute

CLASHES = ["score", "predicted", "offending", "n_words", "n_hit", "items", "hit_spans", "size", "source_size", "target", "taken", "copies", "_k", "kept", "numbers", "spans", "set", "id", "first", "a.b"]
LONG = " ".join(f"w{i % 7919}x{i}" for i in range(20000))
ODD = [(1, LONG), (2, LONG + " more"), (3, None), (4, ""), (5, " \n\t\n"), (None, "a text without a number"), (6, "one"), (6, "one"), (7, "a line\nanother line of words"), (7, "other text\nof the same number"), (8, "a line"), (9, "é😀 " * 30)]


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    base = f"file://{tmp_path_factory.mktemp('stages')}"
    rows = [(i + 100, t) for i, t in corpus] + ODD
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 3}" if k % 5 else None, len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.select("*", *(F.lit(7).alias(c) for c in CLASHES)).write.parquet(f"{base}/documents.parquet")
    docs.limit(0).write.parquet(f"{base}/none.parquet")
    spark.createDataFrame([(i, 0) for i, _ in rows if i] + [(None, 1), (7, None)], "doc_id long, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(0, corpus[3][1]), (1, None), (None, "x y z")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def texts(df):
    return sorted((r["doc_id"] or -1, r["text"] or "") for r in df.select("doc_id", "text").collect())


def test_each_stage_with_clashing_names(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != "mixing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            assert out.select(*(F.col(f"`{c}`") for c in CLASHES)).distinct().collect() == [tuple([7] * len(CLASHES))], name
        else:
            assert {"size", "taken", "copies", "size_of_document", "copies_of_document", "a.b"} <= set(out.columns)
            assert {r[0] for r in out.select("size_of_document").distinct().collect()} == {7}
        ids = {i for i, _ in texts(out)}
        if name in ("toxicity", "decontamination"):
            assert {-1, 1, 2, 3, 4, 5, 6, 7, 8, 9} <= ids, name
        if name == "line_dedup":
            # 8 stands in 7, and goes; blank ones and those without a number stay.
            assert {-1, 1, 3, 4, 5, 6, 7, 9} <= ids and 8 not in ids and texts(out).count((6, "one")) == 2
        if name == "near_dedup":
            assert 2 not in ids and {-1, 1, 3, 4, 5, 6, 7} <= ids and texts(out).count((6, "one")) == 2


def test_an_empty_table_goes_through_all_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/none.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_the_whole_pipeline_against_its_stages_and_near_copies(spark, folder):
    """run() is the stages one by one; of exact copies no second one comes through, and of near copies no line that the first has."""
    out = corpus_pipeline.run(spark, folder)
    kept = {r["doc_id"]: r["text"] for r in out.select("doc_id", "text").collect()}
    assert len(kept) > 20 and not {3, 4, 5, 8} & kept.keys()
    lines = [x for t in kept.values() for x in t.split("\n") if brute.WORD.search(x)]
    assert len(lines) == len(set(lines)) + lines.count("one") - min(1, lines.count("one"))
    sets = {i: brute.shingles(t) for i, t in kept.items() if i is not None}
    part = brute.components(sets)
    assert all(part[i] == i for i in sets)


@pytest.mark.parametrize("operator", [repetition, mix, line_dedup, remove_repeats, pii_report, near_duplicates, secret_report])
def test_operators_take_odd_rows_and_names(spark, folder, operator):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    n = docs.count()
    assert operator(docs).count() == n
    assert operator(spark.read.parquet(f"{folder}/none.parquet")).count() == 0


def test_operators_with_two_tables_take_odd_rows_and_names(spark, folder):
    docs, labels, bench = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("documents", "labels", "benchmark"))
    assert toxicity(docs, labels).count() == docs.count() == decontaminate(docs, bench).count()
    assert {r["n_words"] for r in decontaminate(docs, bench).where("doc_id = 1").collect()} == {20000}
    # Beyond one shard the benchmark is joined, null ids and repeated rows included.
    one, many = ([tuple(r) for r in decontaminate(docs, bench, shard_bytes=s).select("doc_id", "n_words", "n_hit", "items_sha256", "contaminated", "hit_spans").collect()] for s in (1 << 20, 0))
    key = lambda r: (r[0] or -1, *map(str, r))
    assert sorted(one, key=key) == sorted(many, key=key)
