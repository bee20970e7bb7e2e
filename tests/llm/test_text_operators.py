import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from tessel.llm import repetition as rep
from tessel.llm import text as tx
from tessel.llm.decontaminate import decontaminate
from tessel.llm.near_dup import near_duplicates
from tessel.llm.phrase_dedup import remove_repeats
from tessel.llm.repetition import repetition


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\té\x1c\x85　", max_size=40), max_size=8))
def test_words_and_grams(texts):
    flat, ends = tx.split(*tx.raw(pa.array(texts, pa.string())))
    words = [brute.words(t) for t in texts]
    assert flat.to_pylist() == [w for x in words for w in x] and ends.tolist() == np.cumsum([len(w) for w in words]).tolist()
    hashes = tx.hashed(flat)
    assert len(set(hashes.tolist())) == len({w for x in words for w in x})
    for n in (1, 3, 5):
        ok, grams = tx.inside(ends, n, len(hashes)), tx.Grams(hashes)(n)
        assert len(set(grams[ok].tolist())) == len({g for w in words for g in brute.windows(w, n)}) and ok.sum() == sum(max(0, len(w) - n + 1) for w in words)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=4))
def test_suffix_array_repeats(texts):
    flat, ends = tx.split(*tx.raw(pa.array([" ".join(t) for t in texts], pa.string())))
    got, _ = rep.repeats(tx.hashed(flat), ends)
    assert got.tolist() == [x for t in texts for x in brute.longest_repeats(t)]


def test_repetition(docs, corpus, empty):
    got = by_id(repetition(docs).collect())
    for i, text in corpus:
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == brute.repetition(text)
        assert not (got[i]["kept"] and got[i]["base_failed"])
    assert repetition(empty).count() == 0 and repetition(docs.union(docs)).count() == 2 * len(corpus)


def test_phrases(docs, corpus, empty, spark):
    got = by_id(remove_repeats(docs).collect())
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == brute.phrases(corpus)
    assert remove_repeats(empty).count() == 0
    twice = remove_repeats(docs.union(docs)).collect()
    assert len(twice) == 2 * len(corpus) and {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in by_id(twice).items()} == brute.phrases(corpus)
    text = " ".join(f"w{i}" for i in range(25))
    rows = remove_repeats(spark.createDataFrame([(None, text), (3, text), (None, text + " " + text)], "doc_id long, text string")).collect()
    assert sorted(r["n_removed"] for r in rows) == [0, 0, 25]


def test_near_duplicates(docs, corpus, empty, spark):
    got = by_id(near_duplicates(docs).collect())
    sets = {i: brute.shingles(t) for i, t in corpus}
    want = brute.components(sets)
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert near_duplicates(empty).count() == 0 and near_duplicates(docs.union(docs)).count() == 2 * len(corpus)
    nulls = near_duplicates(spark.createDataFrame([(None, "a b c"), (4, "a b c"), (9, "a b c")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"], r["kept"]) for r in nulls) == [(-1, None, True), (4, 4, True), (9, 4, False)]


def test_chains_are_followed_past_the_hub(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(base[k : k + 40])) for k in range(0, 20)]
    got = by_id(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert {i: r["component_id"] for i, r in got.items()} == brute.components({i: brute.shingles(t) for i, t in rows})


@pytest.mark.parametrize("shard", [1 << 20, 60])
def test_decontamination(docs, corpus, empty, spark, shard):
    items = [(1, "a b c d e"), (2, corpus[0][1]), (3, None), (None, "one"), (4, "ONE"), (2, "a b c d e"), (5, "...")]
    items += [(k, " ".join(brute.words(corpus[k][1])[:15])) for k in range(10, 20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate(docs, bench, shard_bytes=shard).collect())
    assert {i: tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for i, r in got.items()} == brute.decontaminate(corpus, items)
    assert decontaminate(empty, bench, shard_bytes=shard).count() == 0
    assert decontaminate(docs, bench.limit(0), shard_bytes=shard).where("contaminated").count() == 0
