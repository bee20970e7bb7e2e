"""The public API: a database of vector collections, their handles, and queries.

A collection's rows are Parquet files that a manifest names; a query is a DataFrame over the files of one manifest, so it
sees one state of the collection whatever is written meanwhile. Small batches are written by the driver (they are there
already), tables by the executors.
"""

from __future__ import annotations

import copy
import hashlib
import json
import shutil
import time
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessel.errors import CollectionAlreadyExists, CollectionNotFound, Corrupt, InvalidInput, Kv, StaleCollection
from tessel.functions import checks
from tessel.functions.filters import Filter, canonical
from tessel.functions.metrics import Metric
from tessel.operators import exact, index
from tessel.sources.manifest import MAX_ID, Catalog, CollectionConfig, Entry, Manifest

ROW = "id bigint, vector array<float>, metadata string"
ARROW_ROW = pa.schema([("id", pa.int64()), ("vector", pa.list_(pa.float32())), ("metadata", pa.string())])


#: Bytes that rows inserted through the driver may take if no capacity is given.
DRIVER_BYTES = 1 << 30
#: New rows that are indexed as a small graph of their own, at most, and how many such graphs there may be before they are merged.
SEGMENT_ROWS, SEGMENTS = 256, 8
#: Pages of data files are checked against their checksums.
CHECKED = {"parquet.page.verify-checksum.enabled": "true"}


@dataclass(frozen=True)
class DbOptions:
    """map_size bounds all rows if it is given. By default only what passes through the driver is bounded, and tables (append) are not."""

    map_size: int | None = None

    def __post_init__(self) -> None:
        if self.map_size is not None and self.map_size < 1 << 20:
            raise InvalidInput("the capacity is 1 MiB at least")


@dataclass(frozen=True)
class ScoredVector:
    id: int
    score: float
    metadata: object  # the parsed JSON value


class VectorDb:
    """Open or create a database. Use as a context manager, or close()."""

    def __init__(self, spark: SparkSession, path: str | Path, options: DbOptions = DbOptions()) -> None:
        self.spark, self.path = spark, Path(path).resolve()
        self._bounded = options.map_size is not None
        self._catalog = Catalog(self.path, options.map_size if self._bounded else DRIVER_BYTES)
        #: Files that were compared with the manifest since this database was opened.
        self._sound: set[tuple] = set()

    open = classmethod(lambda cls, spark, path, options=DbOptions(): cls(spark, path, options))

    def close(self) -> None:
        self._catalog.close()

    def __enter__(self) -> VectorDb:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    # The catalog

    def create_collection(self, name: str, dim: int, metric: Metric | str) -> Collection:
        checks.name(name)
        checks.dim(dim)
        metric = metric if isinstance(metric, Metric) else Metric.parse(metric)
        with self._catalog.mutex:
            now = self._catalog.read()
            if name in now.collections:
                raise CollectionAlreadyExists(name)
            now.generation += 1
            now.collections[name] = Entry(CollectionConfig(dim, metric.value, 0, now.generation, 0))
            self._catalog.commit(now)
            return Collection(self, name, now.generation)

    def collection(self, name: str) -> Collection:
        with self._catalog.mutex:
            now = self._catalog.read()
            if name not in now.collections:
                raise CollectionNotFound(name)
            return Collection(self, name, now.collections[name].config.generation)

    def list_collections(self) -> list[str]:
        with self._catalog.mutex:
            return sorted(self._catalog.read().collections)

    def delete_collection(self, name: str) -> bool:
        with self._catalog.mutex:
            now = self._catalog.read()
            if name not in now.collections:
                return False
            del now.collections[name]
            self._catalog.commit(now)
            return True

    def catalog(self) -> DataFrame:
        """(name, dim, metric, next_id, generation, revision), a row for each collection."""
        with self._catalog.mutex:
            now = self._catalog.read()
        rows = [(n, e.config.dim, e.config.metric, e.config.next_id, e.config.generation, e.config.revision) for n, e in sorted(now.collections.items())]
        return self.spark.createDataFrame(rows, "name string, dim int, metric string, next_id bigint, generation bigint, revision bigint")

    def allocate_vector_id(self, name: str) -> int:
        """Take the next id for a collection without storing anything under it."""
        with self._catalog.mutex:
            now = self._catalog.read()
            if name not in now.collections:
                raise CollectionNotFound(name)
            first = _take(now, now.collections[name], 1)
            self._catalog.commit(now)
            return first

    # The audit log

    def append_log(self, seq: int, op_type: str, vector_id: int, timestamp: int | None = None) -> None:
        """op_type is Upsert or Delete; a later entry under the same seq replaces the earlier one."""
        if op_type not in ("Upsert", "Delete"):
            raise InvalidInput(f"operation {op_type!r}")
        with self._catalog.mutex:
            now = self._catalog.read()
            name = f"logs/{len(now.logs):08d}-{uuid.uuid4().hex}.parquet"
            table = pa.table({"seq": pa.array([seq], pa.int64()), "op_type": [op_type], "vector_id": pa.array([vector_id], pa.int64()), "timestamp": pa.array([int(time.time()) if timestamp is None else timestamp], pa.int64()), "entry": pa.array([len(now.logs)], pa.int64())})
            _write(self.path / name, table)
            now.logs.append(name)
            self._catalog.commit(now)

    def replay_log(self) -> DataFrame:
        """(seq, op_type, vector_id, timestamp), the last entry of each seq, in order of seq."""
        with self._catalog.mutex:
            logs = [self._file(x) for x in self._catalog.read().logs]
        schema = "seq bigint, op_type string, vector_id bigint, timestamp bigint, entry bigint"
        rows = self.spark.read.schema(schema).parquet(*logs) if logs else self.spark.createDataFrame([], schema)
        last = rows.groupBy("seq").agg(F.max_by(F.struct("op_type", "vector_id", "timestamp"), "entry").alias("last"))
        return last.select("seq", "last.*").orderBy("seq")

    def _file(self, name: str) -> str:
        return f"file://{self.path / name}"


def _take(now: Manifest, entry: Entry, n: int) -> int:
    if now.next_id > MAX_ID - n:
        raise Kv("ID space exhausted")
    first = now.next_id
    now.next_id = entry.config.next_id = first + n
    return first


def _write(path: Path, table: pa.Table) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(table, path, compression="zstd")


class Collection:
    """A handle on one incarnation of a collection: once that is dropped, every use is a StaleCollection."""

    def __init__(self, db: VectorDb, name: str, generation: int) -> None:
        self.db, self._name, self._generation = db, name, generation

    @property
    def name(self) -> str:
        return self._name

    def config(self) -> CollectionConfig:
        with self.db._catalog.mutex:
            return copy.copy(self._entry(self.db._catalog.read()).config)

    def _entry(self, now: Manifest) -> Entry:
        entry = now.collections.get(self._name)
        if entry is None or entry.config.generation != self._generation:
            raise StaleCollection(self._name)
        return entry

    @property
    def _folder(self) -> str:
        return f"{self._name}.g{self._generation}"

    # Writing

    def upsert_vector(self, vector: Sequence[float], metadata=None) -> int:
        """Insert one row; it never replaces another."""
        return self.upsert_batch([(vector, metadata)])[0]

    def upsert_batch(self, rows: Iterable[tuple[Sequence[float], object]]) -> list[int]:
        """Insert rows at once or not at all; ids are contiguous, in input order."""
        rows = list(rows)
        with self.db._catalog.mutex:
            now = self.db._catalog.read()
            entry = self._entry(now)
            for vector, _ in rows:
                checks.vector(vector, entry.config.dim)
            if not rows:
                return []
            try:
                texts = [canonical(m) for _, m in rows]
            except (TypeError, ValueError) as e:
                raise InvalidInput(f"metadata: {e}") from e
            now.bytes += sum(len(t.encode()) + 4 * entry.config.dim for t in texts)
            if now.bytes > self.db._catalog.capacity:
                raise Kv(f"{now.bytes} bytes exceed the capacity of {self.db._catalog.capacity}")
            first = _take(now, entry, len(rows))
            ids = list(range(first, first + len(rows)))
            entry.config.revision += 1
            name = f"data/{self._folder}/batch-{entry.config.revision}-{uuid.uuid4().hex}.parquet"
            _write(self.db.path / name, pa.table([pa.array(ids, pa.int64()), pa.array([list(map(float, v)) for v, _ in rows], pa.list_(pa.float32())), pa.array(texts, pa.string())], schema=ARROW_ROW))
            entry.batches.append([name, len(rows)])
            entry.rows += len(rows)
            self.db._catalog.commit(now)
            return ids

    def append(self, rows: DataFrame, order: str, vector: str = "vector", metadata: str | None = "metadata", *, once: str | None = None) -> tuple[int, int]:
        """Insert a table (metadata are JSON texts) at once; ids are contiguous in the order of a column, of equal ones in that of metadata and vector.
        Returns the first id and the number.

        Rows are range-partitioned by the order column; partition sizes give offsets, and rows are numbered in their partitions. With ``once``, a name for this
        table, a repetition of the append under the same name inserts nothing.
        """
        with self.db._catalog.mutex:
            now = self.db._catalog.read()
            entry = self._entry(now)
            if once is not None:
                if once in entry.done:
                    return now.next_id, 0
                entry.done = [x for x in entry.done if x.rpartition(":")[0] != once.rpartition(":")[0]] + [once]
            checks.vectors(rows, entry.config.dim, order, vector)
            text = F.to_json(F.try_parse_json(F.col(metadata))) if metadata else F.lit("null")
            text = F.coalesce(F.when(text.isNotNull(), F.col(metadata)) if metadata else text, F.lit("null"))
            parts = max(1, self.db.spark.sparkContext.defaultParallelism)
            dealt = rows.select(F.col(order).alias("_o"), F.col(vector).cast("array<float>").alias("vector"), text.alias("metadata")).repartitionByRange(parts, "_o").withColumn("_p", F.spark_partition_id())
            stage, name = f"data/{self._folder}/stage-{uuid.uuid4().hex}", f"data/{self._folder}/batch-{entry.config.revision + 1}-{uuid.uuid4().hex}"
            dealt.write.parquet(self.db._file(stage))
            staged = self.db.spark.read.parquet(self.db._file(stage))
            # As many rows as partitions, whatever the table's size.
            sizes = staged.groupBy("_p").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("metadata")).alias("b")).orderBy("_p").collect()
            n = sum(s["n"] for s in sizes)
            if not n:
                shutil.rmtree(self.db.path / stage)
                return now.next_id, 0
            if self.db._bounded:
                now.bytes += sum(s["b"] + 4 * entry.config.dim * s["n"] for s in sizes)
                if now.bytes > self.db._catalog.capacity:
                    shutil.rmtree(self.db.path / stage)
                    raise Kv(f"{now.bytes} bytes exceed the capacity of {self.db._catalog.capacity}")
            first, starts, at = _take(now, entry, n), [], now.next_id - n
            for s in sizes:
                starts.append((s["_p"], at))
                at += s["n"]
            offsets = F.broadcast(self.db.spark.createDataFrame(starts, "_p int, _at bigint"))
            numbered = staged.join(offsets, "_p").withColumn("id", F.col("_at") + F.row_number().over(W.partitionBy("_p").orderBy("_o", "metadata", "vector")) - 1)
            numbered.select("id", "vector", "metadata").write.parquet(self.db._file(name))
            entry.config.revision += 1
            entry.batches.append([name, n])
            entry.rows += n
            self.db._catalog.commit(now)
            shutil.rmtree(self.db.path / stage)
            return first, n

    def delete_vector(self, vector_id: int) -> bool:
        """False if the id isn't a live row of this collection."""
        with self.db._catalog.mutex:
            now = self.db._catalog.read()
            entry = self._entry(now)
            if not self._holds(entry, vector_id):
                return False
            entry.config.revision += 1
            name = f"data/{self._folder}/tombs-{entry.config.revision}-{uuid.uuid4().hex}.parquet"
            _write(self.db.path / name, pa.table({"id": pa.array([vector_id], pa.int64())}))
            entry.tombstones.append(name)
            entry.deleted += 1
            self.db._catalog.commit(now)
            return True

    def _holds(self, entry: Entry, vector_id: int) -> bool:
        try:
            found = entry.batches and ds.dataset([p for b, _ in entry.batches for p in _parts(self.db.path / b)]).scanner(columns=["id"], filter=pc.field("id") == vector_id).head(1).num_rows
            gone = entry.tombstones and ds.dataset([p for t in entry.tombstones for p in _parts(self.db.path / t)]).scanner(filter=pc.field("id") == vector_id).head(1).num_rows
        except (OSError, pa.ArrowInvalid) as e:
            raise Corrupt(str(e)) from e
        return bool(found) and not gone

    def replace_note(self, source: str, rows: Iterable[tuple[Sequence[float], object]]) -> list[int]:
        """Delete all rows whose metadata name the source, then insert the new ones under new ids; two commits."""
        named = F.try_variant_get(F.try_parse_json("metadata"), "$.source", "string") == source
        with self.db._catalog.mutex:
            now = self.db._catalog.read()
            entry = self._entry(now)
            gone = self.rows().where(named).select("id")
            name = f"data/{self._folder}/tombs-{entry.config.revision + 1}-{uuid.uuid4().hex}"
            gone.write.parquet(self.db._file(name))
            n = self.db.spark.read.schema("id bigint").parquet(self.db._file(name)).count()
            if n:
                entry.config.revision += 1
                entry.tombstones.append(name)
                entry.deleted += n
                self.db._catalog.commit(now)
            return self.upsert_batch(rows)

    def compact(self) -> None:
        """Rewrite the live rows, with their ids, and drop the index."""
        with self.db._catalog.mutex:
            now = self.db._catalog.read()
            entry = self._entry(now)
            entry.config.revision += 1
            name = f"data/{self._folder}/batch-{entry.config.revision}-{uuid.uuid4().hex}"
            live = entry.rows - entry.deleted
            if live:
                self.rows().write.parquet(self.db._file(name))
            entry.batches, entry.tombstones, entry.rows, entry.deleted, entry.index = [[name, live]] if live else [], [], live, 0, None
            self.db._catalog.commit(now)

    # Reading

    def rows(self) -> DataFrame:
        """(id, vector, metadata) of the live rows, as they are now."""
        with self.db._catalog.mutex:
            return self._rows(self._entry(self.db._catalog.read()))

    def _rows(self, entry: Entry, *more: Column) -> DataFrame:
        spark = self.db.spark
        if not entry.batches:
            return spark.createDataFrame([], f"{ROW}, file string" if more else ROW)
        self._check(entry)
        rows = spark.read.schema(ROW).options(**CHECKED).parquet(*(self.db._file(b) for b, _ in entry.batches))
        rows = rows.select("*", *more) if more else rows
        gone = self._gone(entry)
        return rows if gone is None else rows.join(gone, "id", "left_anti")

    def _check(self, entry: Entry) -> None:
        """Each file's footer must agree with the manifest, once since the database was opened: whatever is missing, cut off or not of the schema is Corrupt."""
        for name, rows in entry.batches:
            if (name,) in self.db._sound:
                continue
            try:
                parts = [pq.ParquetFile(x) for x in _parts(self.db.path / name)]
                found, kinds = sum(x.metadata.num_rows for x in parts), {tuple(x.schema_arrow.names) for x in parts}
            except (OSError, pa.ArrowInvalid, pa.ArrowException) as e:
                raise Corrupt(f"{name}: {e}") from e
            if found != rows or kinds != {tuple(ARROW_ROW.names)}:
                raise Corrupt(f"{name}: {found} rows where the manifest has {rows}, or other columns")
            self.db._sound.add((name,))

    def _gone(self, entry: Entry) -> DataFrame | None:
        return self.db.spark.read.schema("id bigint").parquet(*(self.db._file(t) for t in entry.tombstones)) if entry.tombstones else None

    def locations(self) -> DataFrame:
        """(id, collection, dim, file) of the live rows, ascending by id."""
        with self.db._catalog.mutex:
            entry = self._entry(self.db._catalog.read())
            rows = self._rows(entry, F.col("_metadata.file_path").alias("file"))
        return rows.select("id", F.lit(self._name).alias("collection"), F.lit(entry.config.dim).alias("dim"), "file").orderBy("id")

    def get_metadata(self, vector_id: int):
        """The parsed metadata of a live row; None also if there is no such row."""
        found = self.rows().where(F.col("id") == vector_id).select("metadata").first()
        return None if found is None or found[0] is None else json.loads(found[0])

    def query(self, vector: Sequence[float], k: int) -> QueryBuilder:
        return QueryBuilder(self, tuple(vector), k)

    def query_batch(self, queries: DataFrame, k: int) -> DataFrame:
        """(qid, id, score, rank, metadata): exact best k for each of a table of queries (qid, query)."""
        metric = Metric.parse(self.config().metric)
        rows = self.rows()
        hits = exact.knn_join_arrow(queries, rows.select("id", "vector"), k, metric)
        return hits.join(rows.select("id", "metadata"), "id", "left").select("qid", "id", "score", "rank", "metadata")

    # The index

    def refresh_index(self, *, shards: int | None = None) -> DataFrame:
        """Nodes (index.NODES) of the graphs of the current revision: reused, extended, or built anew, and published."""
        return index.nodes_of(self.graphs(shards=shards), self.config().dim)

    def graphs(self, *, shards: int | None = None) -> DataFrame:
        """The graphs (index.GRAPHS) themselves.

        A published index is compared with its digest and its graphs with the rules of sound ones when it is first used; whatever is wrong with it, it is
        built anew. Deletions leave it as it is, a few new rows become a graph of their own, more are inserted into the graphs of their shards.
        """
        with self.db._catalog.mutex:
            now = self.db._catalog.read()
            entry = self._entry(now)
            config, spark = entry.config, self.db.spark
            metric, known = Metric.parse(config.metric), entry.index
            if known and not ("state" in known and known["generation"] == config.generation and known["dim"] == config.dim and known["revision"] <= config.revision and shards in (None, known["shards"]) and self._trusted(known, metric)):
                known = None
            if known:
                read = lambda info: spark.read.schema(index.GRAPHS).parquet(self.db._file(info["path"] + "/base"), *(self.db._file(x) for x, _ in info["segments"]))
                fresh = entry.rows - known["seen"]
                if known["revision"] == config.revision:
                    return read(known)
                if not fresh or fresh <= SEGMENT_ROWS and len(known["segments"]) < SEGMENTS:
                    entry.index = known | {"revision": config.revision, "seen": entry.rows, "batches": len(entry.batches), "segments": known["segments"] + ([self._segment(entry, known, metric)] if fresh else [])}
                    self.db._catalog.commit(now)
                    return read(entry.index)
            rows = self._rows(entry)
            shards = known["shards"] if known else shards or index.shards_for(entry.rows - entry.deleted, config.dim)
            new = index.extend(spark.read.schema(index.GRAPHS).parquet(self.db._file(known["path"] + "/base")), rows, metric, config.dim, shards) if known else index.build(rows, metric, config.dim, shards)
            path = f"index/{self._folder}/r{config.revision}-{uuid.uuid4().hex}"
            new.write.option("maxRecordsPerFile", 1).parquet(self.db._file(path + "/base"))
            graphs = spark.read.schema(index.GRAPHS).parquet(self.db._file(path + "/base"))
            entry.index = {"path": path, "revision": config.revision, "generation": config.generation, "dim": config.dim, "shards": shards, "seen": entry.rows, "batches": len(entry.batches), "state": list(index.state(graphs, metric, config.dim)), "segments": []}
            self.db._sound.add((path, "base"))
            self.db._catalog.commit(now)
            return graphs

    def _segment(self, entry: Entry, known: dict, metric: Metric) -> list[str]:
        """Index the rows of the batches since the index was made in a graph of their own; a file and its digest. SEGMENT_ROWS rows at most."""
        try:
            rows = ds.dataset([p for b, _ in entry.batches[known["batches"] :] for p in _parts(self.db.path / b)]).to_table(columns=["id", "vector"]).sort_by("id")
            if entry.tombstones:
                gone = ds.dataset([p for t in entry.tombstones for p in _parts(self.db.path / t)]).to_table(columns=["id"], filter=pc.field("id").isin(rows.column("id")))
                rows = rows.filter(pc.invert(pc.is_in(rows.column("id"), value_set=gone.column("id").combine_chunks())))
        except (OSError, pa.ArrowInvalid) as e:
            raise Corrupt(str(e)) from e
        graph = index.grown(metric, entry.config.dim, rows.column("id").to_pylist(), rows.column("vector").to_pylist())
        name = f"{known['path']}/segment-{len(known['segments'])}-{uuid.uuid4().hex}.parquet"
        _write(self.db.path / name, index.row_of(known["shards"] + len(known["segments"]), graph))
        return [name, hashlib.sha256((self.db.path / name).read_bytes()).hexdigest()]

    def _trusted(self, known: dict, metric: Metric) -> bool:
        try:
            for name, digest in known["segments"]:
                if (name, digest) not in self.db._sound:
                    if hashlib.sha256((self.db.path / name).read_bytes()).hexdigest() != digest:
                        return False
                    self.db._sound.add((name, digest))
            base = (known["path"], "base")
            if base not in self.db._sound or not (self.db.path / known["path"] / "base").exists():
                graphs = self.db.spark.read.schema(index.GRAPHS).parquet(self.db._file(known["path"] + "/base"))
                if list(index.state(graphs, metric, known["dim"])) != known["state"] or known["state"][1] < 0:
                    return False
                self.db._sound.add(base)
        except Exception:  # derived data: whatever is wrong with it, it is built anew
            return False
        return True

    def index_info(self) -> dict | None:
        """Constants of the published index, what it was built from, its number of nodes (len), whether it has none (is_empty), and level and id of its entry
        points, by graph; None without one."""
        with self.db._catalog.mutex:
            found = self._entry(self.db._catalog.read()).index
            if found is None:
                return None
            graphs = self.db.spark.read.schema(index.GRAPHS).parquet(self.db._file(found["path"] + "/base"), *(self.db._file(x) for x, _ in found["segments"]))
        tops = graphs.where(F.size("ids") > 0).select("shard", F.size("ids").alias("n"), F.array_max("levels").alias("level"), F.element_at("ids", F.array_position("levels", F.array_max("levels")).cast("int")).alias("id")).collect()  # a row for each graph
        size = sum(r["n"] for r in tops)
        return found | {"m": index.M, "m_bottom": index.M_BOTTOM, "ef_construction": 128, "len": size, "is_empty": size == 0, "max_level": max((r["level"] for r in tops), default=0), "entry_points": {r["shard"]: r["id"] for r in tops}}


def _parts(path: Path) -> list[str]:
    return [str(path)] if path.is_file() else sorted(str(x) for x in path.glob("*.parquet"))


@dataclass(frozen=True)
class QueryBuilder:
    """A query that hasn't run. Each setter returns a new one."""

    collection: Collection
    vector: tuple[float, ...]
    k: int
    _filter: Filter | None = None
    _exact: bool = False
    _ef: int = 64

    def filter(self, condition: Filter) -> QueryBuilder:
        """Rank only rows that match; this makes the query exact."""
        return replace(self, _filter=condition)

    def exact(self) -> QueryBuilder:
        return replace(self, _exact=True)

    def ef_search(self, width: int) -> QueryBuilder:
        return replace(self, _ef=width)

    def to_df(self) -> DataFrame:
        """(id, score, metadata), best first, over the state of the collection at this call.

        The ranking itself is lazy. An approximate query first brings the index up to date, which runs jobs and publishes it if it isn't.
        """
        config = self.collection.config()
        checks.vector(self.vector, config.dim)
        if self._ef <= 0:
            raise InvalidInput("ef_search is 1 at least")
        spark = self.collection.db.spark
        if self.k <= 0:
            return spark.createDataFrame([], "id bigint, score float, metadata string")
        metric = Metric.parse(config.metric)
        rows = self.collection.rows()
        if self._exact or self._filter is not None:
            rows = rows.where(self._filter.column()) if self._filter is not None else rows
            return exact.top_k(rows, self.vector, self.k, metric).select("id", "score", "metadata")
        with self.collection.db._catalog.mutex:
            nodes = self.collection.graphs()
            entry = self.collection._entry(self.collection.db._catalog.read())
            gone, among = self.collection._gone(entry), entry.index["shards"] + len(entry.index["segments"]) if entry.index else 1
        hits = index.search(nodes, [(0, self.vector)], self.k, self._ef, metric, config.dim, gone, among)
        # k rows at most: the metadata of these alone are looked up.
        found = hits.join(rows.select("id", "metadata"), "id", "left")
        return found.orderBy("rank").select("id", "score", "metadata")

    def execute(self) -> list[ScoredVector]:
        """The hits themselves; k rows at most. Data that can't be read is Corrupt."""
        try:
            found = self.to_df().collect()
        except (Py4JJavaError, PySparkException) as e:
            if any(x in str(e) for x in ("ParquetDecodingException", "CRC", "checksum", "FAILED_READ_FILE", "is not a Parquet file")):
                raise Corrupt(str(e)[:500]) from e
            raise
        return [ScoredVector(r["id"], r["score"], None if r["metadata"] is None else json.loads(r["metadata"])) for r in found]
