"""Benchmark decontamination by winnowing.

The k-gram hashes of a text are winnowed: of every window of 13 words the least hash is its fingerprint. A span of 13 words
that occurs in both an item and a document gives the same fingerprint in both, so none is missed. Document fingerprints are
looked up among the benchmark's; where one is found, the hit is extended to the whole window and confirmed by a second,
independent hash of all its words. Items shorter than a window are looked up whole.

A benchmark of at most SHARD_BYTES is broadcast, and all documents are read against it in one narrow pass without a shuffle. A larger
one is never held as a whole: its fingerprints are a table, and so are those of the documents; the two are joined, and of the documents
that share one the windows are joined with the benchmark's. Documents are read twice then, whatever the benchmark's size.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.shared import append, cut, id_and_text, own, release, tune
from tessel.llm.text import LOWER, Grams, U, blocks, covered, doc_of, hashed, inside, mix, per_doc, raw, sliding, split, starts_of

#: A-Z in lower case; ASCII other than letters and digits becomes a space.
FOLD = bytes(LOWER[b] if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
#: Bytes of benchmark text that are broadcast at most.
SHARD_BYTES = 8 << 20
_TABLE = 20  # bits of the table that is asked before the sorted fingerprints


class Shard(NamedTuple):
    """What one broadcast holds: fingerprints, windows of full length and shorter items, with the items that have them."""

    prints: np.ndarray
    table: np.ndarray
    windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by length: hashes, first place in items, items
    names: list[str]


def folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and each text's end."""
    offsets, data = raw(texts)
    flat, ends = split(offsets, data.translate(FOLD))
    return hashed(flat), ends


def compile_shard(names: list[str], texts: list[str], window: int, k: int) -> Shard:
    words, ends = folded(pa.array(texts, pa.string()))
    grams, item, size = Grams(words), doc_of(ends), ends - starts_of(ends)
    full = np.flatnonzero(inside(ends, window, len(words)))
    prints = np.unique(sliding(grams(k), window - k + 1)[full])
    table = np.zeros(1 << _TABLE, bool)
    table[(mix(prints) >> U(64 - _TABLE)).astype(np.int64)] = True
    found = {window: (grams.at(window, full), item[full])}
    for n in np.unique(size[(size > 0) & (size < window)]).tolist():
        own = np.flatnonzero(size == n)
        found[n] = (grams.at(n, starts_of(ends)[own]), own)
    windows = {}
    for n, (hashes, items) in found.items():
        both = np.unique(np.stack([hashes, items.astype(U)]), axis=1)
        keys, first = np.unique(both[0], return_index=True)
        windows[n] = (keys, np.append(first, both.shape[1]), both[1].astype(np.int64))
    return Shard(prints, table, windows, names)


def search(words: np.ndarray, ends: np.ndarray, shard: Shard, window: int, k: int) -> tuple[np.ndarray, list[set[str]]]:
    """Which words an item's window covers, and each document's items."""
    hit = np.zeros(len(words), bool)
    items: list[set[str]] = [set() for _ in ends]
    grams, docs = Grams(words), doc_of(ends)
    for size, (keys, first, owners) in shard.windows.items():
        if not len(keys) or len(words) < size:
            continue
        if size == window:
            prints = sliding(grams(k), window - k + 1)
            at = np.flatnonzero(shard.table[(mix(prints) >> U(64 - _TABLE)).astype(np.int64)])
            at = at[np.isin(prints[at], shard.prints) & inside(ends, size, len(words))[at]]
        else:
            at = np.flatnonzero(inside(ends, size, len(words)))
        own = grams.at(size, at)
        place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        ok = keys[place] == own
        at, place = at[ok], place[ok]
        hit |= covered(at, size, len(words))
        for doc, p in np.unique(np.stack([docs[at], place]), axis=1).T.tolist():
            items[doc].update(shard.names[x] for x in owners[first[p] : first[p + 1]])
    return hit, items


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


HITS = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("hit_spans", T.ArrayType(T.IntegerType()))]


def _broadcast(docs: DataFrame, shard: Shard, window: int, k: int, prefix: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(tuple(shard))  # broadcasts are pickled plainly: no class of this package in them

    def look(block: pa.RecordBatch) -> list[pa.Array]:
        words, ends = folded(block.column("text"))
        hit, items = search(words, ends, Shard(*shared.value), window, k)
        n_hit = per_doc(hit, ends)
        spans = []
        for start, stop, n in zip(starts_of(ends).tolist(), ends.tolist(), n_hit.tolist(), strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate([[0], hit[start:stop].view(np.int8), [0]]))) if n else []
            spans.append(np.asarray(edges, np.int32))
        return [pa.array(ends - starts_of(ends)), pa.array(n_hit), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int32()))]

    return append(docs, look, [T.StructField(prefix + f.name, f.dataType) for f in HITS])


def windows(rows: DataFrame, sizes: list[int], k: int, columns: list[str], *, whole_only: bool = False, prints_only: bool = False) -> DataFrame:
    """(size, print, key, at, *columns) of every window of the sizes in each text: its fingerprint, its hash and the word it starts at.

    With whole_only, of each text the windows of the greatest size, or the whole text if it is shorter; with prints_only, one row for each fingerprint of a text.
    """
    tune(rows.sparkSession)
    top = max(sizes, default=1)

    def cut_up(batches):
        for block in blocks(batches):
            words, ends = folded(block.column("text"))
            grams, owner, long = Grams(words), doc_of(ends), ends - starts_of(ends)
            for size in sizes:
                if len(words) < size:
                    continue
                at = np.flatnonzero(inside(ends, size, len(words)))
                if whole_only and size < top:
                    at = at[long[owner[at]] == size]
                small = min(k, size)
                prints, key, own = sliding(grams(small), size - small + 1)[at], grams.at(size, at), owner[at]
                if prints_only:
                    once = np.unique(np.stack([own.astype(U), prints]), axis=1, return_index=True)[1]
                    at, prints, key, own = at[once], prints[once], key[once], own[once]
                take = pa.array(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), size, np.int32)), pa.array(prints.view(np.int64)), pa.array(key.view(np.int64)), pa.array((at - starts_of(ends)[own]).astype(np.int32)), *(block.column(c).take(take) for c in columns)], names=["size", "print", "key", "at", *columns])

    schema = T.StructType([T.StructField("size", T.IntegerType()), T.StructField("print", T.LongType()), T.StructField("key", T.LongType()), T.StructField("at", T.IntegerType()), *(rows.schema[c] for c in columns)])
    return rows.select("text", *columns).mapInArrow(cut_up, schema)


def _joined(docs: DataFrame, benchmark: DataFrame, window: int, k: int, prefix: str) -> DataFrame:
    """The same by joins of fingerprints and windows, for a benchmark of any size."""
    known = cut(windows(benchmark, list(range(1, window + 1)), k, ["item"], whole_only=True).select("size", "print", "key", "item").distinct())
    sizes = sorted(r[0] for r in known.select("size").distinct().collect())  # as many as a window has words at most
    key = ["doc_id", "text_id"]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    # Null ids are told from others by a column of their own, as joins need values.
    texts = texts.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.struct(F.col("doc_id").isNull().alias("none"), "text_id").alias("text_id"), "text")
    met = windows(texts, sizes, k, key, prints_only=True).join(known.select("size", "print").distinct(), ["size", "print"], "left_semi").select(*key).distinct()
    found = windows(texts.join(met, key, "left_semi"), sizes, k, key).select("size", "key", "at", *key)
    found = cut(found.join(known.select("size", "key").distinct(), ["size", "key"], "left_semi").distinct())
    items = found.select("size", "key", *key).distinct().join(known.select("size", "key", "item").distinct(), ["size", "key"]).groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items"))
    places = found.groupBy(*key).agg(F.collect_set(F.struct("at", "size")).alias("places"))

    def union(batches):
        for b in batches:
            counts, joined = [], []
            for lists in b.column("places").to_pylist():
                out: list[int] = []
                for s, e in sorted((x["at"], x["at"] + x["size"]) for x in lists):
                    if out and s <= out[-1]:
                        out[-1] = max(out[-1], e)
                    else:
                        out += [s, e]
                counts.append(sum(out[1::2]) - sum(out[::2]))
                joined.append(out)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(counts, pa.int64()), pa.array(joined, pa.list_(pa.int32()))], names=[*key, "n_hit", "hit_spans"])

    schema = T.StructType([*places.schema.fields[:2], HITS[1], HITS[3]])
    hits = cut(places.mapInArrow(union, schema).join(items, key).select(F.col("doc_id").alias(f"{prefix}d"), F.col("text_id").alias(f"{prefix}t"), *(F.col(c).alias(f"{prefix}_{c}") for c in ("n_hit", "items", "hit_spans"))))
    release(known, found)
    same = (F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")) == F.col(f"{prefix}d")) & (F.struct(F.col("doc_id").isNull(), F.xxhash64("text")) == F.col(f"{prefix}t"))
    n_words = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long"), F.lit(0).cast("long"))
    none = {"n_hit": F.lit(0).cast("long"), "items": F.array().cast("array<string>"), "hit_spans": F.array().cast("array<int>")}
    return docs.join(hits, same, "left").select(*own(docs), n_words.alias(f"{prefix}n_words"), *(F.coalesce(f"{prefix}_{c}", v).alias(prefix + c) for c, v in none.items()))


def find_hits(docs: DataFrame, benchmark: DataFrame, *, item: str = "item_id", text: str = "text", window: int = 13, k: int = 5, shard_bytes: int = SHARD_BYTES, prefix: str = "") -> DataFrame:
    """docs (with doc_id and text) and n_words, n_hit, items (ids as strings, sorted) and hit_spans (word positions: start, end, start, ...).

    A document's words are hit where any window of ``window`` item words occurs, or a whole item of fewer. Null and empty
    texts have no words; items without an id or text count for nothing, and items that repeat an id count as one. Repeated
    rows are judged each on their own. With an empty benchmark nothing is hit, and an empty table gives an empty one. Texts of any length are read whole.
    The new columns' names begin with a prefix, for tables that have columns of these names.
    """
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).dropna()
    if (items.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0) > shard_bytes:
        return _joined(docs, items, window, k, prefix)
    rows = items.collect()  # shard_bytes at most
    return _broadcast(docs, compile_shard([r["item"] for r in rows], [r["text"] for r in rows], window, k), window, k, prefix)


def contaminated(share: int = 20, prefix: str = ""):
    """The rule on n_hit and n_words: any hit, and at least one word in ``share`` hit."""
    return (F.col(f"{prefix}n_hit") > 0) & (share * F.col(f"{prefix}n_hit") >= F.col(f"{prefix}n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, hit_spans; see find_hits().

    Other columns of docs, whatever their names, are not read.
    """
    hits = find_hits(id_and_text(docs), benchmark, **options)
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"), "items", "hit_spans")
