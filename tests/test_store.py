import struct
import threading

import pytest

from tessel.db import DbOptions, VectorDb
from tessel.errors import CollectionAlreadyExists, CollectionNotFound, Corrupt, DatabaseLocked, DimensionMismatch, InvalidInput, Io, Kv, Poisoned, StaleCollection
from tessel.functions.filters import Filter


@pytest.fixture
def db(spark, tmp_path):
    with VectorDb(spark, tmp_path / "db") as made:
        yield made


def test_names_and_dims(db):
    for name in ("", "../escape", "/tmp/escape", ".", "a/b", "a\\b", "héllo", "a\n", "x" * 129):
        with pytest.raises(InvalidInput):
            db.create_collection(name, 2, "cosine")
    for dim in (0, 65537):
        with pytest.raises(InvalidInput):
            db.create_collection("a", dim, "cosine")
    db.create_collection("a", 2, "cosine")
    with pytest.raises(CollectionAlreadyExists):
        db.create_collection("a", 2, "cosine")
    with pytest.raises(CollectionNotFound):
        db.collection("b")
    assert db.list_collections() == ["a"] and db.delete_collection("a") and not db.delete_collection("a")


def test_batches_are_checked_before_anything_changes(db):
    a, b = db.create_collection("a", 2, "euclidean"), db.create_collection("b", 2, "euclidean")
    for bad, error in (([1.0], DimensionMismatch), ([1.0, float("nan")], InvalidInput), ([float("inf"), 0.0], InvalidInput), ([float("nan")], DimensionMismatch)):
        with pytest.raises(error):
            a.upsert_batch([([3.0, 4.0], None), (bad, None)])
    assert a.config().revision == 0 and a.upsert_batch([]) == []
    assert a.upsert_batch([([3.0, 4.0], {"row": 0}), ([0.0, 0.0], {"row": 1})]) == [0, 1]
    assert b.upsert_vector([1.0, 0.0]) == 2 and a.upsert_vector([9.0, 9.0]) == 3
    hits = a.query([0.0, 0.0], 2).exact().execute()
    assert [(h.id, h.score, h.metadata) for h in hits] == [(1, 0.0, {"row": 1}), (0, 5.0, {"row": 0})]


def test_query_edges_and_precedence(db):
    a = db.create_collection("a", 2, "cosine")
    assert a.query([1.0, 0.0], 3).exact().execute() == []
    a.upsert_batch([([1.0, 0.0], {"tags": ["rust"]}), ([0.0, 1.0], {"tags": ["python"]}), ([0.9, 0.1], {"tags": ["rust", "db"]})])
    assert a.query([1.0, 0.0], 0).execute() == []
    assert [h.id for h in a.query([1.0, 0.0], 10).filter(Filter("tags", "rust")).execute()] == [0, 2]
    assert [h.id for h in a.query([1.0, 0.0], 10).filter(Filter("tags", "x")).filter(Filter("tags", "db")).execute()] == [2]
    with pytest.raises(InvalidInput):
        a.query([1.0, 0.0], 1).exact().ef_search(0).execute()
    with pytest.raises(DimensionMismatch):
        a.query([float("nan")], 0).ef_search(0).execute()
    with pytest.raises(InvalidInput):
        a.query([float("nan"), 0.0], 0).execute()
    assert [h.id for h in a.query([1.0, 0.0], 2).execute()] == [0, 2]


def test_delete_compact_and_bits(db):
    a = db.create_collection("a", 6, "euclidean")
    bits = [struct.unpack("f", struct.pack("I", 1))[0], -0.0, 3.4028234663852886e38, 1.1754943508222875e-38, struct.unpack("f", struct.pack("f", 0.1))[0], -12345.677734375]
    a.upsert_batch([([0.0] * 6, {"keep": False}), (bits, {"keep": True})])
    assert a.delete_vector(0) and not a.delete_vector(0) and not a.delete_vector(7)
    a.compact()
    (row,) = a.rows().collect()
    assert struct.pack("6f", *row["vector"]) == struct.pack("6f", *bits) and a.get_metadata(1) == {"keep": True} and a.get_metadata(0) is None
    assert a.config().revision == 3 and a.upsert_vector([1.0] * 6, "text") == 2 and a.get_metadata(2) == "text"


def test_stale_handles(db):
    old = db.create_collection("docs", 2, "cosine")
    first = old.upsert_vector([1.0, 0.0])
    db.delete_collection("docs")
    new = db.create_collection("docs", 3, "euclidean")
    for use in (lambda: old.upsert_vector([1.0, 0.0]), lambda: old.upsert_batch([]), lambda: old.delete_vector(0), old.compact, old.config, lambda: old.query([1.0, 0.0], 1).execute()):
        with pytest.raises(StaleCollection):
            use()
    assert new.upsert_vector([1.0, 2.0, 3.0]) > first


def test_lock_and_reopen(spark, tmp_path):
    db = VectorDb(spark, tmp_path)
    db.create_collection("a", 1, "cosine").upsert_vector([1.0], {"x": 1})
    with pytest.raises(DatabaseLocked):
        VectorDb(spark, tmp_path)
    db.close()
    with VectorDb(spark, tmp_path) as again:
        assert again.collection("a").get_metadata(0) == {"x": 1}


def test_capacity_rolls_back(spark, tmp_path):
    with pytest.raises(InvalidInput):
        DbOptions(1)
    with VectorDb(spark, tmp_path, DbOptions(1 << 20)) as db:
        a = db.create_collection("a", 1, "cosine")
        with pytest.raises(Kv):
            a.upsert_vector([1.0], "x" * (2 << 20))
        assert a.upsert_vector([1.0]) == 0


@pytest.mark.parametrize("fault", ["data_written", "manifest_written"])
def test_a_write_that_breaks_off_leaves_nothing(spark, tmp_path, fault):
    db = VectorDb(spark, tmp_path)
    a = db.create_collection("a", 2, "euclidean")
    a.upsert_vector([1.0, 0.0], {"original": True})
    db._catalog.fault = fault
    with pytest.raises(Io):
        a.upsert_batch([([3.0, 4.0], None), ([6.0, 8.0], None)])
    if fault == "manifest_written":
        with pytest.raises(Poisoned):
            a.config()
    db.close()
    for _ in range(2):
        with VectorDb(spark, tmp_path) as again:
            a = again.collection("a")
            assert a.rows().count() == 1 and a.config().revision == 1
            assert len(list((tmp_path / "data" / "a.g1").iterdir())) == 1
    with VectorDb(spark, tmp_path) as again:
        assert again.collection("a").upsert_vector([0.0, 0.0]) == 1


def test_corruption_is_noticed(spark, tmp_path):
    with VectorDb(spark, tmp_path) as db:
        db.create_collection("a", 1, "cosine")
    manifest = tmp_path / (tmp_path / "CURRENT").read_text()
    text = manifest.read_text()
    for bad in (text[:20], text.replace('"format_version": 2', '"format_version": 1'), "[]"):
        manifest.write_text(bad)
        with pytest.raises(Corrupt):
            VectorDb(spark, tmp_path)
    manifest.write_text(text)
    VectorDb(spark, tmp_path).close()
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "x.mdb").write_text("x")
    with pytest.raises(Corrupt):
        VectorDb(spark, tmp_path / "old")


def test_concurrent_batches_are_whole(db):
    a = db.create_collection("a", 2, "cosine")
    seen, made = [], []

    def work(w):
        for b in range(5):
            made.append(a.upsert_batch([([float(w + 1), float(b * 8 + r)], None) for r in range(8)]))
            seen.append(db._catalog.read().collections["a"].rows)

    threads = [threading.Thread(target=work, args=(w,)) for w in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(i for ids in made for i in ids) == list(range(160)) and all(x % 8 == 0 for x in seen)
    assert all(ids == list(range(ids[0], ids[0] + 8)) for ids in made) and a.rows().count() == 160


def test_tables_notes_and_log(db, spark):
    a = db.create_collection("a", 1, "cosine")
    rows = spark.createDataFrame([(i, [float(i + 1)], f'{{"source":"n{i // 5}"}}') for i in range(50)], "o bigint, vector array<float>, metadata string")
    assert a.append(rows.repartition(7), "o") == (0, 50)
    assert {r["id"]: r["vector"][0] for r in a.rows().collect()} == {i: i + 1.0 for i in range(50)}
    with pytest.raises(DimensionMismatch):
        a.append(rows.withColumn("vector", rows["vector"].getItem(0).cast("string")).selectExpr("o", "cast(array() as array<float>) vector", "metadata"), "o")
    assert a.replace_note("n3", [([5.0], {"source": "n3"})]) == [50] and a.rows().count() == 46
    assert a.locations().count() == 46 and db.allocate_vector_id("a") == 51
    batch = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "qid bigint, query array<float>")
    assert a.query_batch(batch, 3).count() == 6
