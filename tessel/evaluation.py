"""The retrieval evaluation: build in two steps, compare approximate, exact and keyword search, and check a note's life."""

from __future__ import annotations

import json
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessel.db import Collection, VectorDb
from tessel.errors import InvalidInput
from tessel.functions.filters import Filter
from tessel.functions.metrics import Metric
from tessel.operators import evaluate as measures
from tessel.operators import exact, index, keyword
from tessel.sources import jsonl

#: The search preset of the evaluation.
K, EF, TOP, COLLECTION = 32, 128, 5, "notes"


def percentile(values: list[float], p: float) -> float | None:
    """Nearest rank: place round((n - 1) * p), half away from zero."""
    return sorted(values)[int((len(values) - 1) * p + 0.5)] if values else None


def top_documents(hits, limit: int = TOP) -> list[dict]:
    """The first hit of each source, in rank order."""
    out: list[dict] = []
    for h in hits:
        source = h.metadata.get("source") if isinstance(h.metadata, dict) else None
        if isinstance(source, str) and all(d["source"] != source for d in out):
            out.append({"source": source, "title": h.metadata.get("title"), "score": h.score, "snippet": (h.metadata.get("text") or "")[:240]})
        if len(out) == limit:
            break
    return out


def semantic_search(collection: Collection, vector, *, tag: str | None = None, full: bool = False):
    query = collection.query(vector, K).ef_search(EF)
    query = query.filter(Filter("tags", tag)) if tag is not None else query
    return (query.exact() if full else query).execute()


def search_file(spark: SparkSession, db_path: str, queries: str) -> dict:
    """Answers for a file of queries: {queries: [{text, query_ms, top_documents}]}."""
    with VectorDb(spark, db_path) as db:
        notes, out, asked = db.collection(COLLECTION), [], jsonl.read_queries(spark, queries)
        check_stored_model(notes, asked)
        for q in asked.toLocalIterator():
            began = time.perf_counter()
            hits = semantic_search(notes, q["vector"], tag=q["filter_tag"])
            out.append({"text": q["text"], "query_ms": (time.perf_counter() - began) * 1e3, "top_documents": top_documents(hits)})
    return {"queries": out}


def check_models(corpus: DataFrame, queries: DataFrame) -> None:
    """Rows and queries must come from one model and have one dimension."""
    rows = corpus.select(F.col("metadata.model").alias("model"), F.size("vector").alias("dim"))
    both = rows.union(queries.select("model", F.size("vector"))).distinct().limit(2).collect()
    if len(both) != 1:
        raise InvalidInput("corpus and queries must share one model and dimension")


def check_stored_model(notes: Collection, queries: DataFrame) -> None:
    """Questions must have the dimension and the model of what is stored; the model is that of the row nearest to the zero vector, as all rows have one."""
    dim = notes.config().dim
    probe = notes.query([0.0] * dim, 1).exact().execute()
    if not probe:
        return
    model = probe[0].metadata.get("model") if isinstance(probe[0].metadata, dict) else None
    if model is None:
        raise InvalidInput("the stored rows name no model")
    other = queries.where((F.col("model").isNull()) | (F.col("model") != model) | (F.size("vector") != dim))
    if not other.isEmpty():
        raise InvalidInput(f"questions must come from {model} and have {dim} dimensions")


def evaluate(spark: SparkSession, corpus_path: str, queries_path: str, db_path: str, *, batch: int = 64, shards: int | None = None, rounds: int = 3) -> dict:
    """The whole report. Rows go in by batches of a size, or as a table each step if the batch is 0. Three quarters of the sources (in order) are stored and indexed, the rest is added, and the database is
    opened again before it is measured; the first round is scored, all are timed. An existing database is refused."""
    if Path(db_path).exists():
        raise InvalidInput(f"{db_path} exists")
    if batch < 0:
        raise InvalidInput("a batch has at least one row")
    corpus, queries = jsonl.read_jsonl(spark, corpus_path, jsonl.CORPUS), jsonl.read_queries(spark, queries_path)
    check_models(corpus, queries)
    rows = corpus.select("vector", F.to_json("metadata").alias("metadata"), F.col("metadata.source").alias("source"), F.struct("metadata.source", "metadata.chunk").alias("o"))
    sources = rows.select("source").distinct()
    n_sources, dim = sources.count(), corpus.select(F.size("vector")).first()[0]
    cut = sources.orderBy("source").limit(max(1, n_sources * 3 // 4)).agg(F.max("source")).first()[0]
    if not n_sources or queries.isEmpty():
        raise InvalidInput("a corpus and questions are needed")
    report: dict = {"model": corpus.select("metadata.model").first()[0], "documents": n_sources, "dimensions": dim, "batch_size": batch}

    def insert(notes: Collection, some: DataFrame) -> int:
        if not batch:
            return notes.append(some, "o")[1]
        n, part = 0, []
        for r in some.orderBy("o").toLocalIterator():
            part.append((r["vector"], json.loads(r["metadata"])))
            if len(part) == batch:
                n += len(notes.upsert_batch(part))
                part = []
        return n + len(notes.upsert_batch(part))

    def timed(name: str, act):
        began = time.perf_counter()
        out = act()
        report[name] = (time.perf_counter() - began) * 1e3
        return out

    with VectorDb(spark, db_path) as db:
        notes = db.create_collection(COLLECTION, dim, Metric.COSINE)
        report["initial_chunks"] = timed("initial_ingest_ms", lambda: insert(notes, rows.where(F.col("source") <= cut)))
        timed("initial_build_ms", lambda: notes.graphs(shards=shards))
        report["incremental_chunks"] = timed("incremental_ingest_ms", lambda: insert(notes, rows.where(F.col("source") > cut)))
    with VectorDb(spark, db_path) as db:
        notes = db.collection(COLLECTION)
        check_stored_model(notes, queries)
        nodes = timed("refresh_ms", notes.graphs)
        report["chunks"] = notes.rows().count()
        asked = queries.withColumn("qid", F.row_number().over(Window.orderBy("text")).cast("long"))
        known = asked.collect()  # a file of questions
        live = notes.rows()
        plain = [(q["qid"], q["vector"]) for q in known if q["filter_tag"] is None]
        meta = live.select("id", "metadata")
        table = spark.createDataFrame(plain, "qid bigint, query array<float>")
        near = index.search(nodes, plain, K, EF, Metric.COSINE, dim)
        full = exact.knn_join_arrow(table, live.select("id", "vector"), K, Metric.COSINE)
        report["recall_at_10"] = measures.recall(near, full).first()[0]
        tagged = [q for q in known if q["filter_tag"] is not None]
        for q in tagged:
            hits = exact.top_k(live.where(Filter("tags", q["filter_tag"]).column()), q["vector"], K, Metric.COSINE)
            ranks = exact.ranked(hits.select(F.lit(q["qid"]).alias("qid"), "id", "score"), K, Metric.COSINE)
            near, full = near.unionByName(ranks), full.unionByName(ranks)
        relevant = asked.select("qid", F.explode("relevant_paths").alias("source"))
        words = asked.select("qid", F.posexplode("keyword_top_sources").alias("position", "source")).withColumn("position", F.col("position") + 1)
        report |= {"n_queries": len(known), "labelled_queries": relevant.select("qid").distinct().count()}
        places: dict[str, dict] = {}
        for name, found in (("semantic", measures.documents(near, meta)), ("exact", measures.documents(full, meta)), ("keyword", words)):
            found = found.select("qid", "position", "source")
            rate, mrr = measures.hit_rate(found, relevant, TOP).first()
            report[name] = {"hit_rate_at_5": rate, "mrr_at_5": mrr}
            places[name] = {r["qid"]: r["position"] for r in measures.first_relevant(found, relevant, TOP).collect()}
        times: dict[str, list[float]] = {"ann": [], "exact": []}
        answers = {}
        for turn in range(rounds):
            for q in known:
                for way in times:
                    began = time.perf_counter()
                    hits = semantic_search(notes, q["vector"], tag=q["filter_tag"], full=way == "exact")
                    times[way].append((time.perf_counter() - began) * 1e3)
                    if turn == 0 and way == "ann":
                        answers[q["qid"]] = {"text": q["text"], "filter_tag": q["filter_tag"], "relevant_paths": list(q["relevant_paths"]), "keyword_top_sources": list(q["keyword_top_sources"]), **{f"{name}_rank_at_5": places[name].get(q["qid"]) for name in places}, "top_documents": top_documents(hits)}
        for way, took in times.items():
            report[f"{way}_ms"] = {"p50": percentile(took, 0.5), "p95": percentile(took, 0.95)}
        report["queries"] = list(answers.values())
        report["note_lifecycle"], probe = lifecycle(notes)
    with VectorDb(spark, db_path) as db:
        again = db.collection(COLLECTION)
        report["note_lifecycle"] &= everything(again, probe) == probe["after"]
    return report


def everything(notes: Collection, probe: dict) -> list[tuple]:
    """(id, score) of all rows from a vector, approximately with a beam of all rows."""
    n = notes.rows().count()
    return [(h.id, h.score) for h in notes.query(probe["vector"], n).ef_search(max(1, n)).execute()]


def lifecycle(notes: Collection) -> tuple[bool, dict]:
    """Delete the first note's rows, look that they and only they are gone, put them back: same rows under new ids. Whether all held, and what a reopened
    database must return."""
    source = F.get_json_object("metadata", "$.source")
    first = notes.rows().select(source.alias("s")).agg(F.min("s")).first()[0]
    own = notes.rows().where(source == first).orderBy("id").collect()
    probe = {"vector": list(own[0]["vector"])}
    before, old = {i for i, _ in everything(notes, probe)}, {r["id"] for r in own}
    notes.replace_note(first, [])
    deleted = {i for i, _ in everything(notes, probe)} == before - old
    ids = set(notes.upsert_batch([(r["vector"], json.loads(r["metadata"])) for r in own]))
    probe["after"] = everything(notes, probe)
    back = {i for i, _ in probe["after"]} == (before - old) | ids and not ids & before and len(ids) == len(own)
    return deleted and back, probe


def keyword_file(spark: SparkSession, corpus: DataFrame, question: str, tag: str | None = None) -> list[str]:
    """The best five sources for a question by BM25."""
    table = corpus.select("metadata.text", "metadata.source", "metadata.tags")
    return [r["source"] for r in keyword.sources(table, question, tag=tag).collect()]
