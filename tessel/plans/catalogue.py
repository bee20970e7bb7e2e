"""The driver's queries over its tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.db import Collection, VectorDb
from tessel.errors import InvalidInput, StaleCollection
from tessel.functions import checks, passages
from tessel.functions.filters import Filter
from tessel.functions.metrics import Metric
from tessel.operators import evaluate, exact, index, keyword
from tessel.operators.hnsw import levels_of
from tessel.sources import jsonl
from tessel.sources.markdown import read_notes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _register(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def _query(name: str, sql: str | None):
    def add(f):
        _register(name, f, sql)
        return f

    return add


# Inputs

def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector, label)"""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<float>").alias("vector"), "label")


def scaled(rows: DataFrame) -> DataFrame:
    """Vectors of different lengths, so that the metrics rank differently."""
    return rows.withColumn("vector", F.transform("vector", lambda x: (x * (1 + F.col("id") % 7)).cast("float")))


def noted(rows: DataFrame) -> DataFrame:
    """Metadata made from id and label: source (five chunks each), chunk, tags, model."""
    tags = F.array(F.concat(F.lit("label_"), F.col("label").cast("string")), F.when(F.col("id") % 2 == 0, "even").otherwise("odd"))
    source = F.concat(F.lit("note_"), F.floor(F.col("id") / 5).cast("string"))
    fields = F.struct(F.col("label").alias("label"), source.alias("source"), (F.col("id") % 5).alias("chunk"), tags.alias("tags"), F.lit("synthetic").alias("model"), F.concat(F.lit("text of "), F.col("id").cast("string")).alias("text"), source.alias("title"))
    return rows.withColumn("metadata", F.to_json(fields))


def vector_of(rows: DataFrame, vec_id: int = 0) -> list[float]:
    return list(rows.where(F.col("id") == vec_id).select("vector").first()[0])


def rounded(rows: DataFrame, *columns: str, places: int = 5) -> DataFrame:
    return rows.select(*columns, F.round(F.col("score").cast("double"), places).alias("score"))


def _ordered(hits: DataFrame) -> DataFrame:
    return rounded(hits, "qid", "id", F.col("rank").cast("int").alias("rank"))


_SCALED = "list_transform(embedding, lambda x: CAST(x * (1 + vec_id % 7) AS FLOAT))"
_DOT = "list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def _sql_score(metric: Metric, a: str, b: str) -> str:
    dot = lambda x, y: _DOT.format(a=x, b=y)
    if metric is Metric.DOT_PRODUCT:
        return f"CAST({dot(a, b)} AS FLOAT)"
    if metric is Metric.EUCLIDEAN:
        return f"CAST(list_distance(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) AS FLOAT)"
    scale = f"(sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"
    return f"CAST(CASE WHEN {scale} = 0 THEN 1.0 ELSE 1.0 - greatest(-1.0, least(1.0, {dot(a, b)} / {scale})) END AS FLOAT)"


def _sql_knn(metric: Metric, k: int, *, table: str, queries: str, where: str = "TRUE") -> str:
    """Best k of table (id, v) for each of queries (qid, q)."""
    way = "DESC" if metric.higher_is_better else "ASC"
    return f"""WITH t AS ({table}), q AS ({queries}), s AS (SELECT qid, id, {_sql_score(metric, "q.q", "t.v")} AS score FROM t, q WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score {way}, id) AS rank FROM s)
SELECT qid, id, CAST(rank AS INT) AS rank, round(CAST(score AS DOUBLE), 5) AS score FROM r WHERE rank <= {k}"""


_PLAIN = "SELECT vec_id AS id, embedding AS v, label FROM embeddings"
_FIRST = "SELECT CAST(0 AS BIGINT) AS qid, embedding AS q FROM embeddings WHERE vec_id = 0"
_FIVE = "SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 20 = 0"


def _only(sql: str) -> str:
    return f"SELECT id, score FROM ({sql})"


# Exact search

for _m in Metric:
    def _top(spark, sf_dir, m=_m):
        rows = embeddings(spark, sf_dir)
        return rounded(exact.top_k(rows, vector_of(rows), 10, m), "id")

    def _top_scaled(spark, sf_dir, m=_m):
        rows = scaled(embeddings(spark, sf_dir))
        return rounded(exact.top_k(rows, vector_of(rows, 3), 10, m), "id")

    def _join(spark, sf_dir, m=_m):
        rows = scaled(embeddings(spark, sf_dir))
        queries = rows.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("query"))
        return _ordered(exact.knn_join(queries, rows, 10, m))

    def _join_arrow(spark, sf_dir, m=_m):
        rows = scaled(embeddings(spark, sf_dir))
        queries = rows.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("query"))
        return _ordered(exact.knn_join_arrow(queries, rows, 10, m))

    _scaled_t = f"SELECT vec_id AS id, {_SCALED} AS v FROM embeddings"
    _register(f"exact_topk_{_m.value}", _top, _only(_sql_knn(_m, 10, table=_PLAIN, queries=_FIRST)))
    _register(f"exact_topk_scaled_{_m.value}", _top_scaled, _only(_sql_knn(_m, 10, table=_scaled_t, queries=f"SELECT CAST(0 AS BIGINT) AS qid, {_SCALED} AS q FROM embeddings WHERE vec_id = 3")))
    for _n, _f in (("knn_join", _join), ("knn_join_arrow", _join_arrow)):
        _register(f"{_n}_{_m.value}", _f, _sql_knn(_m, 10, table=_scaled_t, queries=f"SELECT vec_id AS qid, {_SCALED} AS q FROM embeddings WHERE vec_id % 20 = 0"))


@_query("topk_ties", _only(_sql_knn(Metric.EUCLIDEAN, 11, table=f"{_PLAIN} UNION ALL SELECT vec_id + 100000, embedding, label FROM embeddings", queries=_FIRST)))
def _ties(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    return rounded(exact.top_k(rows.union(rows.withColumn("id", F.col("id") + 100000)), vector_of(rows), 11, Metric.EUCLIDEAN), "id")


@_query("topk_zero_vector", _only(_sql_knn(Metric.COSINE, 7, table=f"{_PLAIN} UNION ALL SELECT CAST(-1 AS BIGINT), list_transform(range(64), lambda x: CAST(0 AS FLOAT)), 0", queries="SELECT CAST(0 AS BIGINT) AS qid, list_transform(range(64), lambda x: CAST(0 AS FLOAT)) AS q")))
def _zero(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    zero = spark.createDataFrame([(-1, [0.0] * 64, 0)], rows.schema)
    return rounded(exact.top_k(rows.union(zero), [0.0] * 64, 7, Metric.COSINE), "id")


@_query("topk_k_gt_n", _only(_sql_knn(Metric.DOT_PRODUCT, 1000000, table=_PLAIN, queries=_FIRST)))
def _k_gt_n(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    return rounded(exact.top_k(rows, vector_of(rows), 1000000, Metric.DOT_PRODUCT), "id")


@_query("topk_k_zero", _only(_sql_knn(Metric.COSINE, 0, table=_PLAIN, queries=_FIRST)))
def _k_zero(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    return rounded(exact.top_k(rows, vector_of(rows), 0, Metric.COSINE), "id")


_PAIRS = ", ".join(f"round(CAST({_sql_score(m, 'a.embedding', 'b.embedding')} AS DOUBLE), 5) AS {m.value}" for m in Metric)


@_query("pairwise_metrics", f"SELECT a.vec_id AS a, b.vec_id AS b, {_PAIRS} FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND b.vec_id > a.vec_id")
def _pairwise(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    a, b = rows.where("id % 100 = 0").select(F.col("id").alias("a"), F.col("vector").alias("x")), rows.select(F.col("id").alias("b"), F.col("vector").alias("y"))
    return a.join(b, F.col("b") > F.col("a")).select("a", "b", *(F.round(m.score(F.col("x"), F.col("y")).cast("double"), 5).alias(m.value) for m in Metric))


@_query("pairwise_metrics_all", f"SELECT a.vec_id AS a, b.vec_id AS b, {_PAIRS} FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0")
def _pairwise_all(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    pairs = exact.pairwise_scores(rows.where("id % 20 = 0"), rows, list(Metric))
    return pairs.select("a", "b", *(F.round(F.col(m.value).cast("double"), 5).alias(m.value) for m in Metric))


# Filters and validation

_TAGS = "['label_' || CAST(label AS VARCHAR), CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'odd' END]"


@_query("filter_tag_topk", _only(_sql_knn(Metric.COSINE, 10, table=f"SELECT vec_id AS id, embedding AS v FROM embeddings WHERE list_contains({_TAGS}, 'label_3')", queries=_FIRST)))
def _filter_tag(spark, sf_dir):
    rows = noted(embeddings(spark, sf_dir))
    return rounded(exact.top_k(rows.where(Filter("tags", "label_3").column()), vector_of(rows), 10, Metric.COSINE), "id")


@_query("filter_missing_field", _only(_sql_knn(Metric.COSINE, 10, table=f"{_PLAIN} WHERE FALSE", queries=_FIRST)))
def _filter_missing(spark, sf_dir):
    rows = noted(embeddings(spark, sf_dir))
    return rounded(exact.top_k(rows.where(Filter("nope", "label_3").column() | Filter("label", "3").column() | Filter("source", "note_0").column()), vector_of(rows), 10, Metric.COSINE), "id")


TRAPS = ['{"tags":"rust"}', '{"tags":[1,"1"]}', '{"tags":[1]}', "null", '["rust"]', '{"a.b":["rust"]}', '{"a":{"b":["rust"]}}', None, '{"tags":[["rust"]]}', '{"tags":[true]}', '{"tags":["true","rust"]}', '{"tags":["rust"]}', "not json"]
_TRUE = {("tags", "1"): [1], ("tags", "true"): [10], ("tags", "rust"): [10, 11], ("a.b", "rust"): [5]}


@_query("filter_string_only", "SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{v}', CAST({i} AS INT))" for (f, v), ids in _TRUE.items() for i in ids) + ") AS t(field, value, row)")
def _filter_traps(spark, sf_dir):
    rows = spark.createDataFrame(list(enumerate(TRAPS)), "row int, metadata string")
    parts = [rows.where(Filter(f, v).column()).select(F.lit(f).alias("field"), F.lit(v).alias("value"), "row") for f, v in _TRUE]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


_BROKEN = "CASE WHEN vec_id % 3 = 0 THEN embedding[1:63] WHEN vec_id % 3 = 1 THEN list_concat(embedding[1:63], [CAST('NaN' AS FLOAT)]) ELSE embedding END"


@_query("vector_validation", f"WITH t AS (SELECT vec_id AS id, {_BROKEN} AS v FROM embeddings) SELECT id, len(v) = 64 AS length_ok, len(list_filter(v, lambda x: isnan(x) OR isinf(x))) = 0 AS finite_ok FROM t")
def _validation(spark, sf_dir):
    rows = embeddings(spark, sf_dir)
    nan = F.array(F.lit(float("nan")).cast("float"))
    broken = F.when(F.col("id") % 3 == 0, F.slice("vector", 1, 63)).when(F.col("id") % 3 == 1, F.concat(F.slice("vector", 1, 63), nan)).otherwise(F.col("vector"))
    return checks.vector_flags(rows.withColumn("vector", broken), 64).select("id", "length_ok", "finite_ok")


# The store: each query writes a database of its own

def folder(spark: SparkSession) -> str:
    """A new local path in the folder that driver and executors share, if that is a local one (a temporary folder in tests); it goes when the application ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or ""
    base = "/" + shared.removeprefix("file:").lstrip("/") if shared.startswith(("file:", "/")) else tempfile.gettempdir()
    path = f"{base.rstrip('/')}/tessel-db-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"file://{path}")
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def database(spark: SparkSession) -> VectorDb:
    return VectorDb(spark, folder(spark))


def filled(db: VectorDb, rows: DataFrame, name: str = "notes", metric: Metric = Metric.COSINE) -> Collection:
    made = db.create_collection(name, 64, metric)
    made.append(noted(rows), "id")
    return made


@_query("catalog_list", "SELECT * FROM (VALUES ('a', 2, 'cosine', CAST(3 AS BIGINT), CAST(2 AS BIGINT), CAST(2 AS BIGINT)), ('b', 3, 'dot_product', CAST(2 AS BIGINT), CAST(1 AS BIGINT), CAST(1 AS BIGINT))) AS t(name, dim, metric, next_id, generation, revision)")
def _catalog(spark, sf_dir):
    with database(spark) as db:
        b = db.create_collection("b", 3, "dot_product")
        a = db.create_collection("a", 2, "cosine")
        db.create_collection("c", 2, "euclidean")
        a.upsert_vector([1.0, 0.0])
        b.upsert_vector([1.0, 0.0, 0.0])
        a.upsert_vector([0.0, 1.0])
        db.delete_collection("c")
        return db.catalog()


@_query("batch_ids", "SELECT vec_id AS id, vec_id AS source_id FROM embeddings")
def _batch_ids(spark, sf_dir):
    with database(spark) as db:
        rows = embeddings(spark, sf_dir)
        made = db.create_collection("notes", 64, Metric.COSINE)
        made.append(rows.withColumn("metadata", F.to_json(F.struct(F.col("id").alias("was")))), "id")
        return made.rows().select("id", F.get_json_object("metadata", "$.was").cast("long").alias("source_id"))


@_query("live_after_delete", "SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (1, 7)")
def _live(spark, sf_dir):
    with database(spark) as db:
        made = filled(db, embeddings(spark, sf_dir))
        assert made.delete_vector(1) and made.delete_vector(7) and not made.delete_vector(7)
        return made.rows().select("id")


@_query("compact_rows", "SELECT vec_id AS id, label FROM embeddings WHERE vec_id <> 2")
def _compact(spark, sf_dir):
    with database(spark) as db:
        made = filled(db, embeddings(spark, sf_dir))
        made.delete_vector(2)
        made.compact()
        return made.rows().select("id", F.get_json_object("metadata", "$.label").cast("int").alias("label"))


@_query("cross_collection_ids", "SELECT * FROM (VALUES ('a', CAST(0 AS BIGINT)), ('a', 1), ('b', 2), ('a', 3)) AS t(name, id)")
def _cross(spark, sf_dir):
    with database(spark) as db:
        a, b = db.create_collection("a", 1, "cosine"), db.create_collection("b", 1, "cosine")
        a.upsert_batch([([1.0], None), ([2.0], None)])
        b.upsert_vector([1.0])
        a.upsert_vector([3.0])
        return a.rows().select(F.lit("a").alias("name"), "id").union(b.rows().select(F.lit("b").alias("name"), "id"))


@_query("recreate_ids", "SELECT CAST(1 AS BIGINT) AS id, CAST(2 AS BIGINT) AS generation")
def _recreate(spark, sf_dir):
    with database(spark) as db:
        db.create_collection("a", 1, "cosine").upsert_vector([1.0])
        db.delete_collection("a")
        made = db.create_collection("a", 1, "cosine")
        made.upsert_vector([1.0])
        return made.rows().select("id", F.lit(made.config().generation).cast("long").alias("generation"))


@_query("revision_history", "SELECT * FROM (VALUES ('created', CAST(0 AS BIGINT)), ('batch', 1), ('empty', 1), ('deleted', 2), ('absent', 2), ('compacted', 3)) AS t(step, revision)")
def _revisions(spark, sf_dir):
    with database(spark) as db:
        made, seen = db.create_collection("a", 1, "cosine"), []
        for step, act in (("created", lambda: None), ("batch", lambda: made.upsert_batch([([1.0], None), ([2.0], None)])), ("empty", lambda: made.upsert_batch([])), ("deleted", lambda: made.delete_vector(0)), ("absent", lambda: made.delete_vector(0)), ("compacted", made.compact)):
            act()
            seen.append((step, made.config().revision))
        return spark.createDataFrame(seen, "step string, revision bigint")


@_query("reopen_rows", "SELECT vec_id AS id, label FROM embeddings")
def _reopen(spark, sf_dir):
    with database(spark) as db:
        filled(db, embeddings(spark, sf_dir))
        path = db.path
    with VectorDb(spark, path) as db:
        return db.collection("notes").rows().select("id", F.get_json_object("metadata", "$.label").cast("int").alias("label"))


@_query("audit_log_replay", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'Delete', CAST(1 AS BIGINT), CAST(300 AS BIGINT)), (1, 'Delete', 1, 200), (5, 'Upsert', 9, 50)) AS t(seq, op_type, vector_id, timestamp)")
def _audit(spark, sf_dir):
    with database(spark) as db:
        for entry in ((0, "Upsert", 1, 100), (5, "Upsert", 9, 50), (1, "Delete", 1, 200), (0, "Delete", 1, 300)):
            db.append_log(*entry)
        return db.replay_log()


@_query("filtered_collection_query", _only(_sql_knn(Metric.COSINE, 10, table="SELECT vec_id AS id, embedding AS v FROM embeddings WHERE vec_id % 2 = 0", queries=_FIRST)))
def _collection_query(spark, sf_dir):
    with database(spark) as db:
        rows = embeddings(spark, sf_dir)
        return rounded(filled(db, rows).query(vector_of(rows), 10).filter(Filter("tags", "even")).to_df(), "id")


@_query("locations", "SELECT vec_id AS id, 'notes' AS collection, CAST(64 AS INT) AS dim FROM embeddings WHERE vec_id <> 3")
def _locations(spark, sf_dir):
    with database(spark) as db:
        made = filled(db, embeddings(spark, sf_dir))
        made.delete_vector(3)
        return made.locations().select("id", "collection", "dim")


@_query("metadata_by_id", "SELECT vec_id AS id, 'note_' || CAST(vec_id // 5 AS VARCHAR) AS source FROM embeddings WHERE vec_id IN (0, 7, 44)")
def _metadata(spark, sf_dir):
    with database(spark) as db:
        made = filled(db, embeddings(spark, sf_dir))
        return spark.createDataFrame([(i, made.get_metadata(i)["source"]) for i in (0, 7, 44)], "id bigint, source string")


@_query("note_replace", "SELECT vec_id AS id, vec_id AS was FROM embeddings WHERE vec_id // 5 <> 3 UNION ALL SELECT (SELECT count(*) FROM embeddings) + vec_id - 15, vec_id FROM embeddings WHERE vec_id // 5 = 3")
def _replace(spark, sf_dir):
    with database(spark) as db:
        rows = embeddings(spark, sf_dir)
        made = db.create_collection("notes", 64, Metric.COSINE)
        meta = F.to_json(F.struct(F.concat(F.lit("note_"), F.floor(F.col("id") / 5).cast("string")).alias("source"), F.col("id").alias("was")))
        made.append(rows.withColumn("metadata", meta), "id")
        old = rows.where("id BETWEEN 15 AND 19").orderBy("id").collect()
        made.replace_note("note_3", [(r["vector"], {"source": "note_3", "was": r["id"]}) for r in old])
        return made.rows().select("id", F.get_json_object("metadata", "$.was").cast("long").alias("was"))


@_query("id_allocation", "SELECT * FROM (VALUES ('row', CAST(0 AS BIGINT)), ('taken', 1), ('batch', 2), ('batch', 3), ('other', 4), ('taken', 5)) AS t(step, id)")
def _allocation(spark, sf_dir):
    with database(spark) as db:
        a, b = db.create_collection("a", 1, "cosine"), db.create_collection("b", 1, "cosine")
        ids = [("row", a.upsert_vector([1.0])), ("taken", db.allocate_vector_id("a"))]
        ids += [("batch", i) for i in a.upsert_batch([([1.0], None), ([2.0], None)])]
        ids += [("other", b.upsert_vector([1.0])), ("taken", db.allocate_vector_id("b"))]
        return spark.createDataFrame(ids, "step string, id bigint")


@_query("stale_handles", "SELECT * FROM (VALUES ('config', TRUE), ('insert', TRUE), ('delete', TRUE), ('query', TRUE), ('compact', TRUE), ('new handle', FALSE)) AS t(use, stale)")
def _stale(spark, sf_dir):
    with database(spark) as db:
        old = db.create_collection("a", 1, "cosine")
        old.upsert_vector([1.0])
        db.delete_collection("a")
        new = db.create_collection("a", 1, "cosine")

        def stale(act) -> bool:
            try:
                act()
            except StaleCollection:
                return True
            return False

        uses = {"config": old.config, "insert": lambda: old.upsert_vector([1.0]), "delete": lambda: old.delete_vector(0), "query": lambda: old.query([1.0], 1).execute(), "compact": old.compact, "new handle": new.config}
        return spark.createDataFrame([(k, stale(f)) for k, f in uses.items()], "use string, stale boolean")


@_query("collection_names", "SELECT DISTINCT p_name AS name, regexp_full_match(p_name, '[A-Za-z0-9][A-Za-z0-9_-]{0,127}') AS valid FROM part UNION SELECT DISTINCT replace(p_name, ' ', '_'), regexp_full_match(replace(p_name, ' ', '_'), '[A-Za-z0-9][A-Za-z0-9_-]{0,127}') FROM part")
def _names(spark, sf_dir):
    def valid(name: str) -> bool:
        try:
            return bool(checks.name(name))
        except InvalidInput:
            return False

    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    names = part.select(F.col("p_name").alias("name")).union(part.select(F.replace("p_name", F.lit(" "), F.lit("_")))).distinct()

    def judge(batches):
        for b in batches:
            yield b.assign(valid=[valid(x) for x in b["name"]])

    return names.mapInPandas(judge, "name string, valid boolean")


@_query("dimension_rules", "SELECT DISTINCT CAST(p_size * 2000 - 4000 AS INT) AS dim, p_size * 2000 - 4000 BETWEEN 1 AND 65536 AS valid FROM part")
def _dims(spark, sf_dir):
    def valid(n: int) -> bool:
        try:
            return bool(checks.dim(n))
        except InvalidInput:
            return False

    sizes = [r[0] for r in spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_size") * 2000 - 4000).cast("int")).distinct().collect()]  # a few dozen
    return spark.createDataFrame([(n, valid(n)) for n in sizes], "dim int, valid boolean")


@_query("jsonl_round_trip", "SELECT vec_id AS id, label, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total, 'é ' || CAST(label AS VARCHAR) AS tag FROM embeddings")
def _jsonl(spark, sf_dir):
    path = f"file://{folder(spark)}/corpus.jsonl"
    rows = embeddings(spark, sf_dir)
    tag = F.concat(F.lit("é "), F.col("label").cast("string"))
    jsonl.write_jsonl(rows.select("vector", F.struct(F.col("id").cast("string").alias("source"), F.lit("t").alias("title"), F.col("label").cast("int").alias("chunk"), F.array(tag).alias("tags"), F.lit("x").alias("text"), F.lit("m").alias("model")).alias("metadata")), path)
    read = jsonl.read_jsonl(spark, path, jsonl.CORPUS)
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return read.select(F.col("metadata.source").cast("long").alias("id"), F.col("metadata.chunk").alias("label"), F.round(total, 5).alias("total"), F.col("metadata.tags")[0].alias("tag"))


@_query("markdown_notes", "SELECT 'b/even/' || CAST(item_id AS VARCHAR) || '.md' AS source, sha256(text) AS sha256 FROM benchmark WHERE item_id % 2 = 0")
def _notes(spark, sf_dir):
    """Every item as a file: the even ones are notes, and the odd ones lie in folders that are skipped or hidden."""
    top = Path(folder(spark))
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").toLocalIterator():
        at = top / ("even" if r["item_id"] % 2 == 0 else ".odd" if r["item_id"] % 3 == 0 else "dist") / f"{r['item_id']}.md"
        at.parent.mkdir(exist_ok=True)
        at.write_text(r["text"], encoding="utf-8", newline="")
    return read_notes(spark, {"b": str(top)}).select("source", "sha256")


# The approximate index

SHARDS = 8


def asked_of(rows, few=False):
    """(qid, query): the rows with an id divisible by 20, or the first ten."""
    return rows.where("id < 10" if few else "id % 20 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("query"))


def stored(graphs: DataFrame) -> DataFrame:
    """Graphs written to the folder that driver and executors share: built once, however many blocks of queries search them. They go when the application ends."""
    spark = graphs.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"file://{tempfile.gettempdir()}"
    path = f"{shared.rstrip('/')}/tessel-graphs-{uuid.uuid4().hex}"
    graphs.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(index.GRAPHS).parquet(path)


def _search(spark, sf_dir, metric, *, ef, scale=True, few=False, shards=SHARDS):
    """The least number of shards is given; a graph stays within the bounds of index.py."""
    rows = embeddings(spark, sf_dir)
    rows = scaled(rows) if scale else rows
    asked = asked_of(rows, few)
    shards = index.shards_for(rows.count(), 64, shards)
    graphs = stored(index.build(rows, metric, 64, shards))
    return rows, index.search_table(graphs, asked, 10, ef, metric, 64, among=shards), asked


for _m in Metric:
    def _full(spark, sf_dir, m=_m):
        return _ordered(_search(spark, sf_dir, m, ef=1_000_000, few=True)[1])

    def _full_all(spark, sf_dir, m=_m):
        return _ordered(_search(spark, sf_dir, m, ef=1_000_000)[1])

    _register(f"hnsw_full_beam_{_m.value}", _full, _sql_knn(_m, 10, table=_scaled_t, queries=f"SELECT vec_id AS qid, {_SCALED} AS q FROM embeddings WHERE vec_id < 10"))
    _register(f"hnsw_full_beam_all_{_m.value}", _full_all, _sql_knn(_m, 10, table=_scaled_t, queries=f"SELECT vec_id AS qid, {_SCALED} AS q FROM embeddings WHERE vec_id % 20 = 0"))


@_query("hnsw_default_beam", None)
def _default_beam(spark, sf_dir):
    return _ordered(_search(spark, sf_dir, Metric.COSINE, ef=64, scale=False, shards=1)[1])


@_query("hnsw_recall_ok", "SELECT TRUE AS ok")
def _recall_ok(spark, sf_dir):
    # One graph of all rows, as far as they fit one, so that a beam of 64 sees a part of it only.
    rows, hits, asked = _search(spark, sf_dir, Metric.COSINE, ef=64, scale=False, shards=1)
    truth = exact.knn_join_arrow(asked, rows, 10, Metric.COSINE)
    return evaluate.recall(hits, truth).select((F.col("recall") >= 0.95).alias("ok"))


def _grown(spark, sf_dir, few):
    rows = scaled(embeddings(spark, sf_dir))
    shards = index.shards_for(rows.count(), 64, SHARDS)
    nodes = stored(index.build(rows.where("id % 4 <> 0"), Metric.EUCLIDEAN, 64, shards))
    nodes = stored(index.extend(nodes, rows, Metric.EUCLIDEAN, 64, shards))
    return _ordered(index.search_table(nodes, asked_of(rows, few), 10, 1_000_000, Metric.EUCLIDEAN, 64, rows.where("id % 11 = 0")))


@_query("hnsw_incremental_full_beam", _sql_knn(Metric.EUCLIDEAN, 10, table=f"{_scaled_t} WHERE vec_id % 11 <> 0", queries=f"SELECT vec_id AS qid, {_SCALED} AS q FROM embeddings WHERE vec_id < 10"))
def _incremental(spark, sf_dir):
    return _grown(spark, sf_dir, True)


@_query("hnsw_incremental_full_beam_all", _sql_knn(Metric.EUCLIDEAN, 10, table=f"{_scaled_t} WHERE vec_id % 11 <> 0", queries=f"SELECT vec_id AS qid, {_SCALED} AS q FROM embeddings WHERE vec_id % 20 = 0"))
def _incremental_all(spark, sf_dir):
    return _grown(spark, sf_dir, False)


@_query("index_integrity_violations", "SELECT * FROM (VALUES ('unique_ids', CAST(0 AS BIGINT)), ('level_range', 0), ('layers', 0), ('degree', 0), ('target_exists', 0), ('target_level', 0), ('self_loop', 0), ('repeated_edge', 0)) AS t(rule, n)")
def _integrity(spark, sf_dir):
    with database(spark) as db:
        return index.violations(filled(db, embeddings(spark, sf_dir)).refresh_index(shards=SHARDS))


_H = [("vec_id::UHUGEINT + 11400714819323198485::UHUGEINT", "z0"), ("xor(z0, z0 >> 30) * 13787848793156543929::UHUGEINT", "z1"), ("xor(z1, z1 >> 27) * 10723151780598845931::UHUGEINT", "z2"), ("xor(z2, z2 >> 31)", "h")]
_LEVEL_SQL = "WITH a AS (SELECT vec_id, " + _H[0][0] + " AS z0 FROM embeddings)" + "".join(f", {n} AS (SELECT vec_id, ({e}) % 18446744073709551616::UHUGEINT AS {v} FROM {p})" for (e, v), n, p in zip(_H[1:], "bcd", "abc", strict=True)) + " SELECT vec_id AS id, CAST(CASE WHEN h % 16 <> 0 THEN 0 WHEN h % 256 <> 0 THEN 1 WHEN h % 4096 <> 0 THEN 2 WHEN h % 65536 <> 0 THEN 3 WHEN h % 1048576 <> 0 THEN 4 ELSE 5 END AS INT) AS level FROM d"


@_query("hnsw_levels", _LEVEL_SQL)
def _levels(spark, sf_dir):
    def levels(batches):
        for b in batches:
            yield b.assign(level=levels_of(b["id"].to_numpy()))

    return embeddings(spark, sf_dir).select("id").mapInPandas(levels, "id bigint, level int")


# Text

QUERY = "the of and then thing"
_BM25 = """WITH docs AS (SELECT doc_id, source, lang, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents{where}), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM docs),
terms AS (SELECT unnest(['the', 'of', 'and', 'then', 'thing']) AS w), df AS (SELECT w, (SELECT count(*) FROM docs WHERE list_contains(t, w)) AS df FROM terms),
f AS (SELECT doc_id, source, w, df, len(t) AS len, len(list_filter(t, lambda x: x = w)) AS f FROM docs, df),
s AS (SELECT doc_id, source, sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / a))) AS score FROM f, st WHERE f > 0 GROUP BY doc_id, source) """


def passages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("id"), "text", "source", F.array("lang").alias("tags"))


@_query("bm25_topk", _BM25.format(where="") + "SELECT doc_id AS id, round(score, 5) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 20")
def _bm25(spark, sf_dir):
    return rounded(keyword.scores(passages_of(spark, sf_dir), QUERY).orderBy(F.col("score").desc(), "id").limit(20), "id")


@_query("bm25_filtered", _BM25.format(where=" WHERE lang = 'en'") + "SELECT doc_id AS id, round(score, 5) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 20")
def _bm25_filtered(spark, sf_dir):
    return rounded(keyword.scores(passages_of(spark, sf_dir), QUERY, tag="en").orderBy(F.col("score").desc(), "id").limit(20), "id")


@_query("bm25_source_dedupe", _BM25.format(where="") + "SELECT source, round(max(score), 5) AS score FROM s GROUP BY source ORDER BY max(s.score) DESC, source LIMIT 5")
def _bm25_sources(spark, sf_dir):
    return rounded(keyword.sources(passages_of(spark, sf_dir), QUERY), "source")


@_query("chunk_windows", """WITH t AS (SELECT doc_id, len(regexp_extract_all(text, '[^\\s]+')) AS n FROM documents), c AS (SELECT doc_id, n, unnest(range(0, 1 + greatest(0, CAST(ceil((n - 320) / 272.0) AS BIGINT)))) AS chunk FROM t WHERE n > 0)
SELECT doc_id, CAST(chunk AS INT) AS chunk, CAST(chunk * 272 AS INT) AS start, CAST(least(chunk * 272 + 320, n) AS INT) AS stop FROM c""")
def _chunks(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tokens = F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0))
    return docs.select("doc_id", F.explode(passages.windows(tokens, 320, 48)).alias("w")).select("doc_id", "w.*")


@_query("doc_title", "SELECT doc_id, coalesce(nullif(regexp_extract('# ' || text, '(?m)^# (.+)$', 1), ''), source) AS title FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, source FROM documents WHERE doc_id % 2 = 1")
def _title(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# "), F.col("text"))).otherwise(F.lit("no heading"))
    return docs.select("doc_id", passages.title(text, F.col("source")).alias("title"))


@_query("passage", "SELECT doc_id, sha256(source || chr(10) || chr(10) || text) AS sha256 FROM documents")
def _passage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.sha2(passages.passage(F.col("source"), F.col("text")), 256).alias("sha256"))


@_query("doc_title_whole", "SELECT doc_id, coalesce(nullif(regexp_extract('intro' || chr(10) || '# ' || text, '(?m)^# (.+)$', 1), ''), source) AS title FROM documents")
def _title_whole(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", passages.title(F.concat(F.lit("intro\n# "), F.col("text")), F.col("source")).alias("title"))


@_query("snippet", "SELECT doc_id, text[1:240] AS snippet FROM documents")
def _snippet(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", passages.snippet(F.col("text")).alias("snippet"))


@_query("source_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _hash(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", passages.content_hash(F.col("text")).alias("sha256"))


# Evaluation

def _judged(spark, sf_dir):
    rows = noted(embeddings(spark, sf_dir))
    queries = rows.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vector").alias("query"))
    hits = exact.knn_join_arrow(queries, rows, 32, Metric.COSINE)
    relevant = queries.select("qid", F.concat(F.lit("note_"), F.floor((F.col("qid") + 5) / 5).cast("string")).alias("source"))
    return evaluate.documents(hits, rows), relevant, hits


_DOCS = f"""WITH h AS ({_sql_knn(Metric.COSINE, 32, table=_PLAIN, queries=_FIVE)}), n AS (SELECT *, 'note_' || CAST(id // 5 AS VARCHAR) AS source FROM h),
f AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY rank) AS k FROM n), p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS position FROM f WHERE k = 1), d AS (SELECT * FROM p WHERE position <= 5),
r AS (SELECT vec_id AS qid, 'note_' || CAST((vec_id + 5) // 5 AS VARCHAR) AS source FROM embeddings WHERE vec_id % 20 = 0), m AS (SELECT r.qid, min(d.position) AS position FROM r LEFT JOIN d USING (qid, source) GROUP BY r.qid) """


@_query("document_dedupe", _DOCS + "SELECT qid, CAST(position AS INT) AS position, source, round(CAST(score AS DOUBLE), 5) AS score, 'text of ' || CAST(id AS VARCHAR) AS snippet FROM d")
def _documents(spark, sf_dir):
    return rounded(_judged(spark, sf_dir)[0], "qid", F.col("position").cast("int").alias("position"), "source", "snippet")


@_query("hit_rate_and_mrr_at_5", _DOCS + "SELECT round(avg(CASE WHEN position IS NULL THEN 0.0 ELSE 1.0 END), 6) AS hit_rate, round(avg(coalesce(1.0 / position, 0.0)), 6) AS mrr FROM m")
def _hit_rate(spark, sf_dir):
    found, relevant, _ = _judged(spark, sf_dir)
    return evaluate.hit_rate(found, relevant).select(F.round("hit_rate", 6).alias("hit_rate"), F.round("mrr", 6).alias("mrr"))


@_query("recall_at_10", "SELECT 0.9 AS recall FROM (SELECT 1)")
def _recall(spark, sf_dir):
    hits = _judged(spark, sf_dir)[2]
    return evaluate.recall(hits.where("rank <> 4"), hits).select(F.round("recall", 6).alias("recall"))


@_query("percentile_nearest_rank", "WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type) SELECT event_type, v[1 + CAST(floor((len(v) - 1) * 0.5 + 0.5) AS INT)] AS p50, v[1 + CAST(floor((len(v) - 1) * 0.95 + 0.5) AS INT)] AS p95 FROM s")
def _percentile(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return evaluate.nearest_ranks(events, "event_type", "value", {"p50": 0.5, "p95": 0.95})


@_query("model_mismatch", "SELECT 'other' AS model")
def _models(spark, sf_dir):
    rows = embeddings(spark, sf_dir).select(F.lit("synthetic").alias("model"))
    return evaluate.mismatched_models(rows, spark.createDataFrame([("synthetic",), ("other",)], "model string"))


@_query("missing_relevance_labels", "SELECT CAST(1 AS BIGINT) AS qid, 'note_none' AS source")
def _missing(spark, sf_dir):
    known = noted(embeddings(spark, sf_dir)).select(F.get_json_object("metadata", "$.source").alias("source"))
    return evaluate.missing_labels(spark.createDataFrame([(0, ["note_0"]), (1, ["note_1", "note_none"])], "qid bigint, relevant_paths array<string>"), known)


