"""The approximate index as a table: one row for each graph, and a graph for each shard of the rows.

A graph's nodes, vectors and links are packed into one row of arrays, so a search reads each graph where it lies, without a shuffle, and
builds its matrices from the arrays at once. A shard holds at most about SHARD_ROWS vectors and SHARD_ELEMENTS numbers, so that its graph fits a
task and its row a file; shards are built, extended and searched independently, and the best of all are merged by (score, id).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.functions.metrics import Metric
from tessel.operators.exact import ranked
from tessel.operators.hnsw import M, M_BOTTOM, MAX_LEVEL, Frozen, Graph

SHARD_ROWS, SHARD_ELEMENTS = 25_000, 16_000_000
#: Numbers in a block of queries of search_table(), and queries times nodes that a walk marks as seen at once.
QUERY_ELEMENTS, MARKS = 1_000_000, 8_000_000
#: So many times ef is the beam where there are several graphs.
STRANGER = 2
GRAPHS = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("levels", T.ArrayType(T.IntegerType())), T.StructField("vectors", T.ArrayType(T.FloatType())), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("links", T.ArrayType(T.IntegerType()))])
NODES = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("node", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("level", T.IntegerType()), T.StructField("vector", T.ArrayType(T.FloatType())), T.StructField("links", T.ArrayType(T.ArrayType(T.IntegerType())))])
ARROW_GRAPH = pa.schema([("shard", pa.int32()), ("ids", pa.list_(pa.int64())), ("levels", pa.list_(pa.int32())), ("vectors", pa.list_(pa.float32())), ("counts", pa.list_(pa.int32())), ("links", pa.list_(pa.int32()))])


def shards_for(rows: int, dim: int, least: int = 1) -> int:
    return max(least, -(-rows // max(1, min(SHARD_ROWS, SHARD_ELEMENTS // dim))))


def with_shard(rows: DataFrame, shards: int) -> DataFrame:
    return rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))


def grown(metric: Metric, dim: int, ids: Iterable[int], vectors: Iterable, graph: Graph | None = None) -> Graph:
    """A graph with further rows inserted in the order given, all of whose nodes links lead to."""
    graph = graph or Graph(metric, dim)
    graph.insert_many(ids, vectors)
    graph.connect()
    return graph


def row_of(shard: int, graph: Graph) -> pa.Table:
    """A graph as a table of one row of GRAPHS."""
    return pa.table([pa.array([shard], pa.int32()), *(pa.array([x], ARROW_GRAPH.field(c).type) for c, x in graph.packed().items())], schema=ARROW_GRAPH)


def _frame(shard: int, graph: Graph) -> pd.DataFrame:
    return pd.DataFrame([{"shard": shard, **graph.packed()}])[GRAPHS.fieldNames()]


def build(rows: DataFrame, metric: Metric, dim: int, shards: int) -> DataFrame:
    """New graphs over rows (id, vector), inserted by ascending id."""
    name = metric.value

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        return _frame(int(pdf["shard"].iloc[0]), grown(Metric(name), dim, pdf["id"].tolist(), pdf["vector"]))

    return with_shard(rows.select("id", "vector"), shards).groupBy("shard").applyInPandas(grow, GRAPHS)


def extend(graphs: DataFrame, rows: DataFrame, metric: Metric, dim: int, shards: int) -> DataFrame:
    """Graphs with the rows whose ids are unknown inserted by ascending id; what is there stays as it is."""
    name = metric.value

    def grow(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        new = new.sort_values("id")
        graph = Graph.unpacked(Metric(name), dim, *(np.asarray(old[c].iloc[0]) for c in GRAPHS.fieldNames()[1:])) if len(old) else None
        return _frame(int((old if len(old) else new)["shard"].iloc[0]), grown(Metric(name), dim, new["id"].tolist(), new["vector"], graph))

    known = graphs.select(F.explode("ids").alias("id"))
    fresh = with_shard(rows.select("id", "vector").join(known, "id", "left_anti"), shards)
    return graphs.groupBy("shard").cogroup(fresh.groupBy("shard")).applyInPandas(grow, GRAPHS)


def _frozen(metric: Metric, dim: int, batch: pa.RecordBatch) -> Iterator[Frozen]:
    for i in range(batch.num_rows):
        ids, levels, vectors, counts, links = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in GRAPHS.fieldNames()[1:])
        yield Frozen(metric, ids, vectors.reshape(-1, dim), levels, counts, links)


def search(graphs: DataFrame, queries: Sequence[tuple[int, Sequence[float]]], k: int, ef: int, metric: Metric, dim: int, deleted: DataFrame | None = None, among: int = 1) -> DataFrame:
    """(qid, id, score, rank) of the best k over all graphs. deleted (id) are routes, never hits.

    queries are held by every task; callers pass them in blocks. ``among`` is the number of graphs: see beam_among().
    """
    ef = beam_among(ef, among)
    name, qids = metric.value, np.array([q for q, _ in queries], np.int64)
    matrix = np.array([v for _, v in queries], np.float64).reshape(len(qids), dim)
    schema = T.StructType([T.StructField("qid", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.FloatType())])
    if deleted is not None:
        # Deleted ids meet their graph, one array for each.
        known = graphs.select("shard", F.explode("ids").alias("id")).join(deleted.select("id").distinct(), "id", "left_semi")
        graphs = graphs.join(known.groupBy("shard").agg(F.collect_list("id").alias("gone")), "shard", "left")
    dead = deleted is not None

    def look(batches):
        for batch in batches:
            for i, graph in enumerate(_frozen(Metric(name), dim, batch)):
                gone = batch.column("gone")[i].as_py() if dead else None
                hidden = np.isin(graph.ids, np.array(gone or [], np.int64))
                step = max(1, MARKS // max(1, len(graph.ids)))
                for s in range(0, len(qids), step):
                    q, ids, score = graph.search(matrix[s : s + step], k, ef, hidden)
                    yield pa.RecordBatch.from_arrays([pa.array(qids[s : s + step][q]), pa.array(ids), pa.array(score)], names=["qid", "id", "score"])

    return ranked(graphs.mapInArrow(look, schema), k, metric)


def beam_among(ef: int, graphs: int) -> int:
    """The width of the beam in each of several graphs. An indexed row that is asked is a node of one graph, and a stranger to the others: there, the walk does not end among
    the neighbours that its links name, and a beam of ef finds fewer of them."""
    return ef if graphs <= 1 else STRANGER * ef


def search_table(graphs: DataFrame, queries: DataFrame, k: int, ef: int, metric: Metric, dim: int, deleted: DataFrame | None = None, block: int | None = None, among: int = 1) -> DataFrame:
    """search() for a table of queries (qid, query), read in blocks (of QUERY_ELEMENTS numbers unless their size is given); each block is one pass over the graphs,
    so these should be stored and not built anew by every pass."""
    out, part, block = None, [], block or max(1, QUERY_ELEMENTS // dim)
    for qid, query in queries.select("qid", "query").toLocalIterator():
        part.append((qid, query))
        if len(part) == block:
            hits = search(graphs, part, k, ef, metric, dim, deleted, among)
            out, part = hits if out is None else out.unionByName(hits), []
    if part or out is None:
        hits = search(graphs, part, k, ef, metric, dim, deleted, among)
        out = hits if out is None else out.unionByName(hits)
    return out


def nodes_of(graphs: DataFrame, dim: int) -> DataFrame:
    """NODES, a row for each node of each graph."""
    def unpack(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                shard = batch.column("shard")[i].as_py()
                ids, levels, vectors, counts, links = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in GRAPHS.fieldNames()[1:])
                ends, starts = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(levels + 1)])
                inner = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(links, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), shard, np.int32)), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids), pa.array(levels), pa.ListArray.from_arrays(pa.array(np.arange(0, len(vectors) + 1, dim), pa.int32()), pa.array(vectors)), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), inner)], names=NODES.fieldNames())

    return graphs.mapInArrow(unpack, NODES)


def state(graphs: DataFrame, metric: Metric, dim: int) -> tuple[int, int, int]:
    """(graphs and nodes as one number each, digest), or a negative digest if a graph is unsound: what a published index is compared with when it is opened."""
    name = metric.value

    def check(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                parts = [batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in GRAPHS.fieldNames()[1:]]
                ids, levels, vectors, counts, links = parts
                fits = len(ids) == len(levels) and len(vectors) == dim * len(ids) and len(counts) == int((levels + 1).sum()) and len(links) == int(counts.sum()) and bool((counts >= 0).all()) and bool((levels >= 0).all()) and bool((levels <= MAX_LEVEL).all())
                try:
                    bad = not fits or Frozen(Metric(name), ids, vectors.reshape(-1, dim), levels, counts, links).faults() > 0
                except (IndexError, ValueError):
                    bad = True
                yield pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64()), pa.array([bool(bad)])], names=["nodes", "bad"])

    digest = graphs.select(F.xxhash64("shard", "ids", "levels", "vectors", "counts", "links").alias("h")).agg(F.bit_xor("h")).first()[0] or 0
    n, nodes, bad = graphs.mapInArrow(check, "nodes bigint, bad boolean").agg(F.count(F.lit(1)), F.sum("nodes"), F.count_if("bad")).first()
    return n, -1 if bad else nodes or 0, digest


def links_of(nodes: DataFrame) -> DataFrame:
    """(shard, node, layer, neighbor), a row for each edge."""
    return nodes.select("shard", "node", F.posexplode("links").alias("layer", "neighbors")).select("shard", "node", "layer", F.explode("neighbors").alias("neighbor"))


def violations(nodes: DataFrame) -> DataFrame:
    """(rule, n): how often each rule of a sound graph is broken, of NODES; a row for each rule."""
    edges = links_of(nodes)
    target = nodes.select("shard", F.col("node").alias("neighbor"), F.col("level").alias("target_level"))
    ends = edges.join(target, ["shard", "neighbor"], "left")
    degrees = nodes.select("shard", "node", F.posexplode("links").alias("layer", "neighbors"))
    checks = [
        ("unique_ids", nodes.groupBy("id").count().where("count > 1")),
        ("level_range", nodes.where((F.col("level") < 0) | (F.col("level") > MAX_LEVEL))),
        ("layers", nodes.where(F.size("links") != F.col("level") + 1)),
        ("degree", degrees.where(F.size("neighbors") > F.when(F.col("layer") == 0, M_BOTTOM).otherwise(M))),
        ("target_exists", ends.where("target_level IS NULL")),
        ("target_level", ends.where("target_level < layer")),
        ("self_loop", edges.where("node = neighbor")),
        ("repeated_edge", edges.groupBy("shard", "node", "layer", "neighbor").count().where("count > 1")),
    ]
    out = None
    for rule, bad in checks:
        row = bad.agg(F.count(F.lit(1)).alias("n")).select(F.lit(rule).alias("rule"), "n")
        out = row if out is None else out.union(row)
    return out
