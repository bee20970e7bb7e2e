import corpus_pipeline
from tessel.llm.decontaminate import decontaminate
from tessel.llm.near_dup import near_duplicates
from tests.llm import brute


def test_stages_keep_what_their_operators_keep(spark, corpus, tmp_path):
    base = f"file://{tmp_path}"
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in corpus], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, int("zz" in (t or ""))) for i, t in corpus], "doc_id long, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(0, corpus[3][1])], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    now = spark.read.parquet(f"{base}/documents.parquet")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        out = stage(spark, now, base)
        out.write.parquet(f"{base}/{n}")
        after = spark.read.parquet(f"{base}/{n}")
        kept = {r["doc_id"]: r["text"] for r in after.collect()}
        if n < 4:
            assert after.columns == docs.columns
        if name == "line_dedup":
            gone = brute.lines(list(before.items()))
            left = {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in before.items()}
            # A document all of whose lines stand in others goes; blank ones stay.
            assert kept == {i: t for i, t in left.items() if brute.words(t) or not brute.words(before[i])} and len(kept) < len(before)
        if name == "near_dedup":
            assert set(kept) == {r["doc_id"] for r in near_duplicates(now).where("kept").collect()}
        if name == "decontamination":
            assert set(kept) == {r["doc_id"] for r in decontaminate(now, spark.read.parquet(f"{base}/benchmark.parquet")).where("NOT contaminated").collect()}
        now = after
    assert "copies" in now.columns and now.where("taken <= 0").count() == 0
    assert corpus_pipeline.run(spark, base).count() == now.count()
