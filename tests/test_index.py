import shutil

import numpy as np
import pytest

from tessel.db import VectorDb
from tessel.functions.metrics import Metric
from tessel.operators import index
from tessel.operators.hnsw import Graph, level_of


def xorshift(seed):
    while True:
        seed ^= (seed << 13) & 0xFFFFFFFFFFFFFFFF
        seed ^= seed >> 7
        seed ^= (seed << 17) & 0xFFFFFFFFFFFFFFFF
        yield (seed >> 40) / 2**24 * 2 - 1


def vectors(draw, n, dim):
    return [[next(draw) for _ in range(dim)] for _ in range(n)]


def truth(metric, rows, query, k):
    scores = metric.rank(metric.pairwise(np.array([query]), np.array([v for _, v in rows]))[0])
    return [rows[i][0] for i in np.lexsort(([r[0] for r in rows], scores))[:k]]


def test_levels():
    counts = np.bincount([level_of(i) for i in range(2000)])
    assert counts.tolist() == [1883, 109, 7, 1]


@pytest.mark.parametrize("metric", list(Metric))
def test_recall_before_and_after_changes(metric):
    draw = xorshift(123456789)
    queries = vectors(draw, 12, 16)
    rows = list(enumerate(np.float32(vectors(draw, 512, 16)).tolist()))
    graph = Graph(metric, 16)
    for i, v in rows:
        graph.insert(i, v)
    hit = sum(len({i for i, _ in graph.search(q, 10, 64)} & set(truth(metric, rows, q, 10))) for q in queries)
    assert hit >= 114
    more = [(512 + i, v) for i, v in enumerate(np.float32(vectors(draw, 64, 16)).tolist())]
    for i, v in more:
        graph.insert(i, v)
    gone = set(range(0, 100, 3))
    live = [r for r in rows + more if r[0] not in gone]
    hit = sum(len({i for i, _ in graph.search(q, 10, 64, gone)} & set(truth(metric, live, q, 10))) for q in queries)
    assert hit >= 114


def test_deleted_nodes_stay_as_routes():
    draw = xorshift(123456789)
    rows = list(enumerate(np.float32(vectors(draw, 128, 16)).tolist()))
    graph = Graph(Metric.COSINE, 16)
    for i, v in rows:
        graph.insert(i, v)
    gone = set(range(120))
    for i, v in ((128, [0.5] * 16), (129, [-0.5] * 16)):
        graph.insert(i, v)
        rows.append((i, v))
    live = [r for r in rows if r[0] not in gone]
    for q in vectors(draw, 5, 16):
        assert [i for i, _ in graph.search(q, 20, 1, gone)] == truth(Metric.COSINE, live, q, 20)
    assert graph.size == 130


def test_published_index_is_reused_extended_and_rebuilt(spark, tmp_path):
    draw = xorshift(987654321)
    with VectorDb(spark, tmp_path) as db:
        a = db.create_collection("a", 8, "euclidean")
        a.upsert_batch([(v, {"row": i}) for i, v in enumerate(vectors(draw, 120, 8))])
        first = a.refresh_index(shards=3)
        path = a.index_info()["path"]
        assert first.count() == 120 and a.refresh_index().count() == 120 and a.index_info()["path"] == path
        assert all(r["n"] == 0 for r in index.violations(first).collect())
        a.upsert_batch([(v, None) for v in vectors(draw, 10, 8)])
        for i in range(5):
            a.delete_vector(i)
        query = vectors(draw, 1, 8)[0]
        assert [h.id for h in a.query(query, 10).ef_search(200).execute()] == [h.id for h in a.query(query, 10).exact().execute()]
        assert a.refresh_index().count() == 130
        shutil.rmtree(tmp_path / a.index_info()["path"])
        assert a.refresh_index().count() == 125
        a.compact()
        assert a.index_info() is None and a.refresh_index().count() == 125


def test_broken_graphs_are_reported(spark):
    rows = [(0, 0, 5, 0, [1.0], [[1, 1, 0, 9]]), (0, 1, 5, 1, [1.0], [[0], [0]])]
    found = {r["rule"]: r["n"] for r in index.violations(spark.createDataFrame(rows, index.NODES)).collect()}
    assert found == {"unique_ids": 1, "level_range": 0, "layers": 0, "degree": 0, "target_exists": 1, "target_level": 1, "self_loop": 1, "repeated_edge": 1}


@pytest.mark.parametrize("metric", list(Metric))
def test_blocks_of_queries_go_the_way_of_single_ones(metric):
    from tessel.operators.hnsw import Frozen

    draw = xorshift(42)
    graph, dead = Graph(metric, 8), {3, 77, 205}
    for i, v in enumerate(np.float32(vectors(draw, 600, 8)).tolist()):
        graph.insert(i, v)
    parts = graph.packed()
    frozen = Frozen(metric, parts["ids"], parts["vectors"].reshape(-1, 8), parts["levels"], parts["counts"], parts["links"])
    assert frozen.faults() == 0
    queries = np.array(vectors(draw, 40, 8))
    q, ids, scores = frozen.search(queries, 10, 16, np.isin(parts["ids"], list(dead)))
    for i, x in enumerate(queries):
        want = graph.search(x, 10, 16, dead)
        assert ids[q == i].tolist() == [a for a, _ in want] and scores[q == i] == pytest.approx([s for _, s in want], rel=1e-6, abs=1e-6)
    again = Graph.unpacked(metric, 8, *parts.values())
    assert again.links == graph.links and again.search(queries[0], 5, 16) == graph.search(queries[0], 5, 16)
    for harm in (lambda p: p["links"].__setitem__(0, 9999), lambda p: p["links"].__setitem__(slice(0, 2), p["links"][2]), lambda p: p["ids"].__setitem__(0, 5)):
        broken = {k: v.copy() for k, v in parts.items()}
        harm(broken)
        assert Frozen(metric, broken["ids"], broken["vectors"].reshape(-1, 8), broken["levels"], broken["counts"], np.minimum(broken["links"], 600)).faults() > 0


def test_levels_at_once():
    from tessel.operators.hnsw import levels_of

    ids = np.array([0, 1, 17, 2**40, 2**63 - 1, *range(5000, 5400)])
    assert levels_of(ids).tolist() == [level_of(int(i)) for i in ids]


def test_damaged_index_is_rebuilt_and_damaged_data_is_corrupt(spark, tmp_path):
    from tessel.errors import Corrupt

    draw = xorshift(5)
    with VectorDb(spark, tmp_path) as db:
        a = db.create_collection("a", 4, "cosine")
        a.upsert_batch([(v, None) for v in vectors(draw, 50, 4)])
        a.refresh_index(shards=2)
        a.upsert_batch([(v, None) for v in vectors(draw, 5, 4)])
        info = a.refresh_index() and a.index_info()
        assert info["len"] == 55 and len(info["segments"]) == 1 and info["state"][1] == 50
        query = vectors(draw, 1, 4)[0]
        want = [h.id for h in a.query(query, 9).exact().execute()]
    # A byte of a graph's arrays is changed, then a file is cut off, then one is missing.
    for harm in (lambda f, x: f.write_bytes(x[:60] + bytes([x[60] ^ 255]) + x[61:]), lambda f, x: f.write_bytes(x[: len(x) // 2]), lambda f, x: f.unlink()):
        file = sorted((tmp_path / info["path"]).rglob("*.parquet"))[0]
        harm(file, file.read_bytes())
        with VectorDb(spark, tmp_path) as db:
            a = db.collection("a")
            assert [h.id for h in a.query(query, 9).ef_search(60).execute()] == want and a.index_info()["path"] != info["path"]
            info = a.index_info()
    data = next((tmp_path / "data").rglob("batch-1-*.parquet"))
    data.write_bytes(data.read_bytes()[:-20])
    with VectorDb(spark, tmp_path) as db, pytest.raises(Corrupt):
        db.collection("a").query(query, 3).exact().execute()


def test_best_of_ties_goes_by_id():
    from tessel.operators.exact import best_of

    scores = np.float32([[0.5, 0.0, -0.0, 0.5, 2.0], [1.0, 1.0, 1.0, 1.0, 1.0]])
    ids = np.array([9, 8, 7, 3, 1])
    assert ids[best_of(scores, ids, 3, Metric.EUCLIDEAN)].tolist() == [[7, 8, 3], [1, 3, 7]]
    assert ids[best_of(scores, ids, 9, Metric.DOT_PRODUCT)].tolist() == [[1, 3, 9, 7, 8], [1, 3, 7, 8, 9]]


def spread_out(n, dim=8):
    """Vectors of very different lengths, and copies: lists cut to the nearest leave some without an incoming link."""
    draw = np.random.default_rng(3)
    made = draw.normal(size=(n, dim)) * (1 + np.arange(n) % 7)[:, None]
    made[n // 2 : n // 2 + 80] = made[0]
    return made.astype(np.float32)


@pytest.mark.parametrize("metric", list(Metric))
def test_wide_beams_leave_nothing_out(metric):
    from tessel.operators.hnsw import M, M_BOTTOM, Frozen

    rows = spread_out(1500)
    first = index.grown(metric, 8, np.flatnonzero(np.arange(1500) % 4 > 0).tolist(), rows[np.arange(1500) % 4 > 0])
    graph = index.grown(metric, 8, range(0, 1500, 4), rows[::4], first)
    parts = graph.packed()
    frozen = Frozen(metric, parts["ids"], parts["vectors"].reshape(-1, 8), parts["levels"], parts["counts"], parts["links"])
    assert frozen.reached().all() and frozen.faults() == 0
    assert all(len(x) <= (M if layer else M_BOTTOM) for layers in graph.links for layer, x in enumerate(layers))
    dead = np.isin(frozen.ids, range(0, 1500, 11))
    q, ids, _ = frozen.search(rows[::50], 10, 1_000_000, dead)
    for i, x in enumerate(rows[::50]):
        assert ids[q == i].tolist() == truth(metric, [(j, v) for j, v in enumerate(rows) if j % 11], x, 10)


@pytest.mark.parametrize("metric", list(Metric))
def test_nearest_beyond_the_error_of_products(metric):
    draw = np.random.default_rng(4)
    far = np.float32(1000 + draw.normal(size=(300, 8)) / 1000)
    rows = np.concatenate([far, far[:40], np.zeros((2, 8), np.float32)])
    ids = draw.permutation(len(rows))
    for k in (1, 10, 400):
        q, place, score = metric.nearest(rows[:20], rows, ids, k, scores=5000)
        for i in range(20):
            want = metric.paired(np.repeat(rows[i : i + 1], len(rows), axis=0), rows)
            order = np.lexsort((ids, metric.rank(want)))[:k]
            assert place[q == i].tolist() == order.tolist() and score[q == i].tolist() == want[order].tolist()


def test_recall_of_rows_inserted_at_once():
    rows = np.random.default_rng(5).normal(size=(3000, 16)).astype(np.float32)
    graph = index.grown(Metric.COSINE, 16, range(3000), rows)
    hit = sum(len({i for i, _ in graph.search(q, 10, 64)} & set(truth(Metric.COSINE, list(enumerate(rows)), q, 10))) for q in rows[::100])
    assert hit >= 285 and graph.levels == [level_of(i) for i in range(3000)]


@pytest.mark.parametrize("metric", list(Metric))
def test_diverse_lists_are_those_of_single_rows_and_done_when_full(metric, monkeypatch):
    from tessel.operators import hnsw

    rows = np.random.default_rng(6).normal(size=(700, 32))
    rows[300:400] = rows[0] + rows[300:400] / 1000
    graph = index.grown(metric, 32, range(700), rows.astype(np.float32))
    some = np.random.default_rng(7).permutation(700)[:12]
    d = graph.between(some, np.arange(700))
    near = np.argsort(d, axis=1, kind="stable")[:, :300]
    near[-1, 45:], d = -1, np.take_along_axis(d, near, axis=1)
    want = [graph.diverse([(x, n) for x, n in zip(a.tolist(), b.tolist(), strict=True) if n >= 0], 16) for a, b in zip(d, near, strict=True)]
    scored, between = [], Graph.between
    monkeypatch.setattr(Graph, "between", lambda self, a, b: scored.append(out := between(self, a, b)) or out)
    assert [[x for x in row if x >= 0] for row in graph.diverse_many(near, d, 16).tolist()] == want
    assert sum(x.size for x in scored) <= len(near) * 300 * (hnsw.RUN + 16) < near.size * 300


def test_rows_of_other_graphs_are_found(spark):
    rows = np.random.default_rng(8).normal(size=(4000, 64)).astype(np.float32)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(rows.tolist())], "id long, vector array<float>")
    nodes = index.build(table, Metric.COSINE, 64, 4).cache()
    asked = table.where("id % 20 = 0").selectExpr("id AS qid", "vector AS query")
    q, place, _ = Metric.COSINE.nearest(rows[::20], rows, np.arange(4000), 10)
    want = {(int(a) * 20, int(b)) for a, b in zip(q, place, strict=True)}
    share = [len(want & {(r["qid"], r["id"]) for r in index.search_table(nodes, asked, 10, 16, Metric.COSINE, 64, among=n).collect()}) / len(want) for n in (1, 4)]
    assert share[0] < 0.98 < share[1]
    nodes.unpersist()
