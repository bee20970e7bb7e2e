"""Distributed union-find: connected components of an edge table by alternating large and small stars.

Each round every node learns the least node near it and passes it on; edges are rewritten until each node hangs directly on
the least node of its component. Only DataFrame operations are used, every round is cut by a written table, and a node with
very many edges is pre-aggregated before its edges are dealt out, after which Spark's skew join can split it.

Edges of several graphs can be settled together: ``g`` tells the graphs apart, and the rounds are shared. A table of at most
FEW_EDGES edges is settled on the driver: each round costs some ten stages, whatever the number of edges.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.shared import cut, first_row, release

AT = ["g", "u"]
#: Edges (of 20 bytes) that the driver settles itself, all of them; of more it sees none.
FEW_EDGES = 1 << 17


def _large(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of u is hung on the least of u and its neighbours; edges have u > v and may repeat."""
    turned = edges.select("g", F.col("v").alias("u"), F.col("u").alias("v"))
    least = edges.union(turned).groupBy(*AT).agg(F.min("v").alias("m")).select(*AT, F.least("u", "m").alias("m"))
    return turned.join(least, AT).select("g", F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """u and its lesser neighbours are hung on the least of these; edges have u > v and may repeat."""
    least = edges.groupBy(*AT).agg(F.min("v").alias("m"))
    hung = edges.join(least, AT).select("g", F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return hung.where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(first_row(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("g", "u", "v")))))


def least_of(g: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(g, node, component) of edges in arrays: nodes learn the least number among their neighbours, and then the one of that number's node."""
    pairs = np.zeros(2 * len(g), [("g", np.int64), ("node", np.int64)])
    pairs["g"], pairs["node"] = np.concatenate([g, g]), np.concatenate([u, v])
    nodes, at = np.unique(pairs, return_inverse=True)
    a, b = at[: len(g)], at[len(g) :]
    # Nodes are numbered in their order, so the least number of a graph's component is its least node.
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        if (least == root[a]).all() and (least == root[b]).all():
            return nodes["g"], nodes["node"], nodes["node"][root]
        for end in (a, b):
            np.minimum.at(root, root[end], least)
        while (root[root] != root).any():
            root = root[root]


def _settled(edges: DataFrame) -> DataFrame:
    """(g, node, component) of few edges, by the driver."""
    got = edges.toArrow()
    found = least_of(*(got.column(c).to_numpy().astype(np.int64) for c in ("g", "u", "v")))
    return edges.sparkSession.createDataFrame(pa.table(list(map(pa.array, found)), ["g", "node", "component"])).select(F.col("g").cast("int").alias("g"), "node", "component")


def graph_components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(g, node, component) for edges (g, a, b): component is the least node reachable. Loops and repeats are harmless."""
    now = cut(edges.select("g", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = _mark(now)
    if 0 < mark[0] <= few:
        out = _settled(now)
        release(now)
        return out
    while mark[0]:
        # The middle of a round is read twice, so it is written.
        old, large = now, cut(_large(now))
        now = cut(_small(large))
        release(old, large)
        last, mark = mark, _mark(now)
        if mark == last:
            break
    # The last table is what the result reads; it goes with the application.
    roots = now.select("g", F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select("g", F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of one graph's edges, for every node that has one."""
    return graph_components(edges.select(F.lit(0).alias("g"), F.col(a).alias("a"), F.col(b).alias("b"))).drop("g")
