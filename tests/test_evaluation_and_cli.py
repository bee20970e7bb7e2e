import json

import numpy as np
import pytest

from tessel import evaluation
from tessel.__main__ import main
from tessel.db import VectorDb
from tessel.errors import InvalidInput
from tessel.report import report_text, search_text
from tessel.streaming.ingest import ingest


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    draw, at = np.random.default_rng(3), tmp_path_factory.mktemp("eval")
    notes = [{"vector": draw.normal(size=8).round(4).tolist(), "metadata": {"source": f"own/n{i // 2}.md", "title": f"Note {i // 2}", "chunk": i % 2, "tags": ["even" if i // 2 % 2 == 0 else "odd"], "text": f"text {i}", "model": "m"}} for i in range(16)]
    queries = [{"text": f"q{i}", "vector": notes[i]["vector"], "model": "m", "relevant_paths": [notes[i]["metadata"]["source"]], "keyword_top_sources": ["x", notes[i]["metadata"]["source"]]} for i in range(4)]
    queries.append({"text": "tagged", "vector": notes[0]["vector"], "model": "m", "filter_tag": "odd"})
    for name, rows in (("corpus", notes), ("queries", queries)):
        (at / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)))
    return at


def test_evaluate_and_search(spark, files, capsys):
    db = files / "db"
    report = evaluation.evaluate(spark, f"file://{files}/corpus.jsonl", f"file://{files}/queries.jsonl", str(db), rounds=1)
    assert report["documents"] == 8 and report["chunks"] == 16 and report["recall_at_10"] == 1.0
    assert report["semantic"] == report["exact"] == {"hit_rate_at_5": 1.0, "mrr_at_5": 1.0} and report["keyword"]["mrr_at_5"] == 0.5
    assert report["note_lifecycle"] and "Recall@10 against exact search: 100.0 %" in report_text(report)
    with pytest.raises(InvalidInput):
        evaluation.evaluate(spark, "x", "y", str(db))
    found = evaluation.search_file(spark, str(db), f"file://{files}/queries.jsonl")
    assert found["queries"][0]["top_documents"][0]["source"] == "own/n0.md" and "Note 0" in search_text(found)
    assert all(d["source"] in {f"own/n{i}.md" for i in (1, 3, 5, 7)} for q in found["queries"] if q["text"] == "tagged" for d in q["top_documents"])
    result = files / "r.json"
    result.write_text(json.dumps(found))
    assert main(["show", str(result), "--markdown"]) == 0 and (files / "r.md").read_text().startswith("q0")
    assert main(["show", str(result), "--markdown", str(result)]) == 1 and main(["show", str(files / "none.json")]) == 1
    assert main(["show", str(result)]) == 0 and "q0" in capsys.readouterr().out


def test_models_must_match(spark):
    rows = spark.createDataFrame([([1.0], ("m",))], "vector array<float>, metadata struct<model:string>")
    asked = spark.createDataFrame([("o", [1.0])], "model string, vector array<float>")
    with pytest.raises(InvalidInput):
        evaluation.check_models(rows, asked)


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, [float(i), 1.0], "{}") for i in range(20)], "o bigint, vector array<float>, metadata string")
    rows.write.parquet(f"file://{tmp_path}/in")
    with VectorDb(spark, tmp_path / "db") as db:
        notes = db.create_collection("notes", 2, "euclidean")
        ingest(spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in"), notes, f"file://{tmp_path}/check", order="o").awaitTermination()
        assert notes.rows().count() == 20


def test_a_repeated_micro_batch_inserts_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(0, [1.0, 1.0], "{}")], "o bigint, vector array<float>, metadata string")
    with VectorDb(spark, tmp_path / "db") as db:
        notes = db.create_collection("notes", 2, "euclidean")
        assert notes.append(rows, "o", once="s:0") == (0, 1) and notes.append(rows, "o", once="s:0") == (1, 0) and notes.append(rows, "o", once="s:1") == (1, 1)
        assert notes.rows().count() == 2


def test_prepare_then_evaluate(spark, tmp_path, monkeypatch, capsys):
    for name, text in (("fern", "# Ferns\nwater them daily " + "and gently " * 400), ("rose", "prune in spring"), ("empty", "")):
        (tmp_path / f"{name}.md").write_text(text)
    (tmp_path / "q.json").write_text(json.dumps([{"text": "water gently", "relevant_paths": ["g/fern.md"]}, {"text": "prune", "filter_tag": "g"}]))
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    args = ["prepare", "--root", f"g={tmp_path}", "--queries", str(tmp_path / "q.json"), "--output", str(tmp_path / "out")]
    assert main([*args, "--chunk-tokens", "100", "--overlap-tokens", "10"]) == 0
    manifest = json.loads((tmp_path / "out/manifest.json").read_text())
    assert [f["source"] for f in manifest["files"]] == ["g/fern.md", "g/rose.md"] and manifest["documents"] == 2 and manifest["chunks"] == 1 + -(-(805 - 100) // 90) + 1
    asked = [json.loads(x) for x in (tmp_path / "out/queries.jsonl").read_text().splitlines()]
    assert asked[0]["keyword_top_sources"] == ["g/fern.md"] and asked[1]["keyword_top_sources"] == ["g/rose.md"] and len(asked[0]["vector"]) == 384
    assert main(["prepare", "--queries-only", "--query", "spring", "--output", str(tmp_path / "out")]) == 0 and (tmp_path / "out/search-queries.jsonl").exists()
    for wrong in (["--overlap-tokens", "400"], ["--root", "no/label=x"], ["--root", f"g={tmp_path}"], ["--query", " "]):
        assert main([*args, *wrong]) == 1
    (tmp_path / "q.json").write_text(json.dumps([{"text": "x", "relevant_paths": ["g/none.md"]}]))
    assert main(args) == 1 and "g/none.md" in capsys.readouterr().err
    db = str(tmp_path / "db")
    report = evaluation.evaluate(spark, f"file://{tmp_path}/out/corpus.jsonl", f"file://{tmp_path}/out/search-queries.jsonl", db, batch=3, rounds=1)
    assert report["model"] == "hashing-384" and report["note_lifecycle"] and report["labelled_queries"] == 0 and report["initial_chunks"] + report["incremental_chunks"] == report["chunks"]


def test_benchmark(spark, tmp_path):
    from tessel import benchmark

    draw = benchmark.numbers()
    assert all(-1 <= next(draw) < 1 for _ in range(1000))
    got = benchmark.run(spark, str(tmp_path / "db"), 60, 4, 2, 16)
    assert got["recall_at_10"] == got["mixed_recall_at_10"] == 1.0 and got["bytes"] > 0 and got["mixed"]["p50_ms"] <= got["mixed"]["p95_ms"]
    with pytest.raises(InvalidInput):
        benchmark.run(spark, str(tmp_path / "db"), 60, 4, 2, 16)
