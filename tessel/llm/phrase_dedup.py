"""Repeated passages: recurring phrases are confirmed, sharded Aho-Corasick automata locate them, and all but the first occurrence go.

1. Every window of 20 words has a fingerprint, the least hash of the 7-word phrases in it. Equal windows have equal
   fingerprints, so a window can recur in another text only if its fingerprint does. Counting fingerprints (about one in eight
   positions) confirms the recurring phrases; a phrase belongs to the first document that has it.
2. Phrases are dealt by that document into shards of about SHARD phrases, so that those of one passage, and of one document with its near copies,
   share a shard. Each shard is compiled into one automaton (pyahocorasick), and every document with a recurring fingerprint streams through the
   automata of all shards that have one of its fingerprints (the others have no phrase of a window of it). A shard that very many documents visit is compiled for several
   parts of them. Words enter an automaton as three symbols of a small alphabet, so its nodes stay narrow; a phrase that it reports is verified by
   the whole hashes of its words. No other step knows where a phrase stands in a document: the windows around the reported places are the only candidates.
3. Candidates meet by a 96-bit hash of their 20 words; the least doc_id is the first. All windows elsewhere are removed, and in
   the last pass later repeats within a document too.

Documents with the same word sequence are found by a 128-bit digest beforehand: all but the least doc_id are removed whole.
Keys that a third of the documents share are pre-aggregated before they are dealt out, and joins on them can be split.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.shared import append, cut, id_and_text, release, tune, with_first
from tessel.llm.text import Grams, U, blocks, covered, doc_of, hashed, inside, mix, pair, per_doc, raw, sliding, split, starts_of

PHRASE = 7
#: Phrases in a shard, on average, and fingerprints (one for eight words) of the documents that visit one copy of it.
SHARD, VISIT = 20_000, 200_000
LONG = T.LongType()


def _words(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    flat, ends = split(*raw(block.column("text")))
    return hashed(flat), ends


def digests(words: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit digests of each document's word sequence."""
    starts = starts_of(ends)
    place = np.arange(len(words), dtype=np.int64) - np.repeat(starts, ends - starts)
    out = []
    for seed in (0x2545F4914F6CDD1D, 0x5851F42D4C957F2D):
        total = np.concatenate([np.zeros(1, U), np.cumsum(mix(words ^ mix(place.astype(U) + U(seed))), dtype=U)])
        out.append(mix(total[ends] - total[starts] + (ends - starts).astype(U)))
    return out


def chosen(words: np.ndarray, ends: np.ndarray, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrase hashes, the fingerprint of each window, and which phrases are the fingerprint of a window around them."""
    grams = Grams(words)
    hashes, span = grams(phrase), window - phrase + 1
    if len(words) < window:
        return hashes, np.zeros(0, U), np.zeros(len(hashes), bool)
    prints = sliding(hashes, span)
    top = np.where(inside(ends, window, len(words)), prints, U(0))
    padded = np.concatenate([np.zeros(span - 1, U), top, np.zeros(span - 1, U)])
    return hashes, prints, (sliding(padded, span, np.maximum) == hashes) & (hashes > 0)


def fingerprints(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """(h, doc_id, text_a): a row for each distinct fingerprint of a document; text_a tells texts apart."""
    tune(docs.sparkSession)

    def run(batches):
        for block in blocks(batches):
            words, ends = _words(block)
            hashes, _, picked = chosen(words, ends, window, phrase)
            at = np.flatnonzero(picked)
            own, key = doc_of(ends)[at], hashes[at]
            order = np.lexsort((key, own))
            own, key = own[order], key[order]
            new = np.ones(len(own), bool)
            new[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1])
            own, key = own[new], key[new]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), block.column("doc_id").take(pa.array(own)), pa.array(digests(words, ends)[0][own].view(np.int64))], names=["h", "doc_id", "text_a"])

    return docs.mapInArrow(run, T.StructType([T.StructField("h", LONG), T.StructField("doc_id", LONG), T.StructField("text_a", LONG)]))


def _spelt(words: np.ndarray) -> str:
    """Each word as three symbols, the first of 64, the next of 64 others, the last of 64 more."""
    out = np.empty((len(words), 3), np.uint8)
    for i in range(3):
        out[:, i] = ((words >> U(58 - 6 * i)) & U(63)).astype(np.uint8) + 64 * i
    return out.tobytes().decode("latin-1")


def locate(machine, words: np.ndarray, ends: np.ndarray, hashes: np.ndarray, prints: np.ndarray, window: int, phrase: int) -> np.ndarray:
    """Starts of the windows whose fingerprint is a phrase that the automaton reports in them."""
    spelt = _spelt(words)
    at: list[int] = []
    value: list[int] = []
    for start, stop in zip(starts_of(ends).tolist(), ends.tolist(), strict=True):
        if stop - start >= window:
            for end, h in machine.iter(spelt[3 * start : 3 * stop]):
                at.append(start + (end + 1) // 3 - phrase)
                value.append(h)
    if not at:
        return np.zeros(0, np.int64)
    where, told = np.array(at, np.int64), np.array(value, np.int64).view(U)
    sure = hashes[where] == told
    where, told = where[sure], np.unique(told[sure])
    near = covered(np.maximum(where - (window - phrase), 0), window - phrase + 1, len(words))
    starts = np.flatnonzero(near[: len(prints)] & inside(ends, window, len(words)))
    return starts[np.isin(prints[starts], told)]


def compiled(phrases: list[tuple[str, int]]):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for spelt, h in phrases:
        machine.add_word(spelt, h)
    machine.make_automaton()
    return machine


STREAM = T.StructType([T.StructField("shard", LONG), T.StructField("part", LONG), T.StructField("kind", T.IntegerType()), T.StructField("doc_id", LONG), T.StructField("text", T.StringType()), T.StructField("h", LONG), T.StructField("spelt", T.BinaryType())])


def dealt(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """STREAM rows: of kind 0 the phrases that belong to a document, spelt, for every part of their shards, and of kind 1 the document for each shard it visits.

    docs have own (h, shard, parts) and visits (shard, parts).
    """
    tune(docs.sparkSession)

    def deal(batches):
        for block in blocks(batches):
            words, ends = _words(block)
            hashes, ids, starts = Grams(words)(phrase), block.column("doc_id").to_numpy(), starts_of(ends)
            rows: list[tuple] = []
            for i, (own, start, stop) in enumerate(zip(block.column("own").to_pylist(), starts.tolist(), ends.tolist(), strict=True)):
                if not own:
                    continue
                # The phrases were chosen in this very text, so each is found in it.
                here = hashes[start : max(start, stop - phrase + 1)]
                asked = np.array([x["h"] for x in own], np.int64).view(U)
                order = np.argsort(here, kind="stable")
                place = order[np.minimum(np.searchsorted(here[order], asked), len(order) - 1)] if len(order) else np.zeros(0, np.int64)
                for x, h, p in zip(own, asked, place.tolist(), strict=False):
                    if here[p] == h:
                        spelt = _spelt(words[start + p : start + p + phrase]).encode("latin-1")
                        rows += [(x["shard"], part, x["h"], spelt) for part in range(x["parts"])]
            if rows:
                n = len(rows)
                shard, part, h, spelt = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(part, pa.int64()), pa.array(np.zeros(n, np.int32)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string()), pa.array(h, pa.int64()), pa.array(spelt, pa.binary())], names=STREAM.fieldNames())
            go = [(i, v["shard"], int(mix(ids[i : i + 1].astype(np.int64).view(U))[0] % U(v["parts"]))) for i, visits in enumerate(block.column("visits").to_pylist()) for v in visits or ()]
            for k in range(0, len(go), 64):
                row, shard, part = zip(*go[k : k + 64], strict=True)
                some = block.take(pa.array(row, pa.int64()))
                n = len(row)
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(part, pa.int64()), pa.array(np.ones(n, np.int32)), some.column("doc_id"), some.column("text"), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=STREAM.fieldNames())

    return docs.select("doc_id", "text", "own", "visits").mapInArrow(deal, STREAM)


def candidates(stream: DataFrame, window: int, phrase: int) -> DataFrame:
    """(a, b, doc_id, at) for the first place in each document of every candidate window; a partition of stream has each of its shards' phrases before the documents."""
    tune(stream.sparkSession)

    def windows_of(machine, block):
        words, ends = _words(block)
        hashes, prints, _ = chosen(words, ends, window, phrase)
        at = locate(machine, words, ends, hashes, prints, window, phrase)
        owner = doc_of(ends)
        a = Grams(words).at(window, at)
        order = np.lexsort((at, a, owner[at]))
        at, a = at[order], a[order]
        first = np.ones(len(at), bool)
        first[1:] = (a[1:] != a[:-1]) | (owner[at][1:] != owner[at][:-1])
        at, a = at[first], a[first]
        b = np.zeros(len(at), U)
        for i in range(window):
            b = (b ^ mix(words[at + i] + U(i))) * U(0x9E3779B97F4A7C15)
        own = owner[at]
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array((b >> U(32)).astype(np.uint32).view(np.int32)), block.column("doc_id").take(pa.array(own)), pa.array((at - starts_of(ends)[own]).astype(np.int32))], names=["a", "b", "doc_id", "at"])

    def run(batches):
        now, phrases, machine = None, [], None
        for batch in batches:
            shard, part, kind = (batch.column(c).to_numpy() for c in ("shard", "part", "kind"))
            edges = np.flatnonzero((shard[1:] != shard[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if start == stop:
                    continue
                if now != (shard[start], part[start]):
                    now, phrases, machine = (shard[start], part[start]), [], None
                rows = batch.slice(start, stop - start)
                if kind[start] == 0:
                    phrases += [(x.decode("latin-1"), h) for x, h in zip(rows.column("spelt").to_pylist(), rows.column("h").to_pylist(), strict=True)]
                elif phrases:
                    machine = machine or compiled(phrases)
                    for block in blocks([rows]):
                        yield windows_of(machine, block)

    return stream.mapInArrow(run, T.StructType([T.StructField("a", LONG), T.StructField("b", T.IntegerType()), T.StructField("doc_id", LONG), T.StructField("at", T.IntegerType())]))


def streamed(docs: DataFrame, window: int, phrase: int, shard: int, visit: int) -> DataFrame:
    """The candidates of all documents: what recurs is confirmed and dealt into shards, and documents visit the shards of their fingerprints."""
    prints = cut(fingerprints(docs, window, phrase))
    recurring = cut(prints.groupBy("h").agg(F.min("text_a").alias("x"), F.max("text_a").alias("y"), F.min("doc_id").alias("owner")).where("x <> y").select("h", "owner"))
    shards = max(1, -(-recurring.count() // shard))
    placed = recurring.withColumn("shard", F.pmod(F.xxhash64("owner"), F.lit(shards)).cast("long"))
    sizes = prints.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    visits = cut(prints.select("h", "doc_id").join(placed.select("h", "shard"), "h").select("doc_id", "shard").distinct().join(sizes, "doc_id"))
    release(prints)
    loads = visits.groupBy("shard").agg(F.ceil(F.sum("n") / F.lit(visit)).cast("long").alias("parts"))
    going = visits.join(loads, "shard").groupBy("doc_id").agg(F.collect_list(F.struct("shard", "parts")).alias("visits"))
    owned = placed.join(loads, "shard").groupBy(F.col("owner").alias("doc_id")).agg(F.collect_list(F.struct("h", "shard", "parts")).alias("own"))
    n = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    stream = dealt(docs.join(going.join(owned, "doc_id", "left"), "doc_id"), window, phrase).repartition(n, "shard", "part").sortWithinPartitions("shard", "part", "kind")
    found = cut(candidates(stream, window, phrase))
    release(recurring, visits)
    return found


def marks(docs: DataFrame, window: int, phrase: int, shard: int, visit: int) -> DataFrame:
    """(doc_id, part): the windows of each document that also start in a document of a smaller id."""
    found = streamed(docs, window, phrase, shard, visit)
    first = found.groupBy("a", "b").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x <> y").select("a", "b", "x")
    out = cut(found.join(first, ["a", "b"]).where("doc_id > x").groupBy("doc_id").agg(F.collect_set("at").alias("part")))
    release(found)
    return out


def copies(docs: DataFrame) -> DataFrame:
    """(doc_id, text_a, text_b) of documents whose whole word sequence also belongs to a smaller id."""

    def sign(block: pa.RecordBatch) -> list[pa.Array]:
        words, ends = _words(block)
        return [*(pa.array(x.view(np.int64)) for x in digests(words, ends)), pa.array(ends - starts_of(ends))]

    key = ["text_a", "text_b"]
    signed = cut(append(docs, sign, [*(T.StructField(x, LONG) for x in key), T.StructField("n", LONG)]).drop("text").where("n > 0"))
    out = cut(with_first(signed, key).where("doc_id > first").select("doc_id", *key))
    release(signed)
    return out


RESULT = [T.StructField("n_words", LONG), T.StructField("n_removed", LONG), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())]


def remove_repeats(docs: DataFrame, *, window: int = 20, phrase: int = PHRASE, shard: int = SHARD, visit: int = VISIT) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256 and kept_text (the kept words, joined by one space).

    A word goes if a window of ``window`` words that covers it also starts earlier: in a smaller doc_id, or before in the same
    document. Windows are judged on the input. Null and empty texts have no words; texts of any length are read whole. Rows that share a doc_id stand at the same
    place, so none of them is earlier than another; rows with a null doc_id are compared with themselves only. An empty table gives an empty
    one, and other columns of docs, whatever their names, are not read.
    """
    texts = id_and_text(docs)
    known = texts.where("doc_id IS NOT NULL AND text IS NOT NULL")
    same = copies(known)
    part = marks(known, window, phrase, shard, visit)
    both = cut(same.groupBy("doc_id").agg(F.collect_set("text_a").alias("whole")).join(part, "doc_id", "full"))
    release(same, part)

    def erase(block: pa.RecordBatch) -> list[pa.Array]:
        offsets, data = raw(block.column("text"))
        flat, ends = split(offsets, data)
        words = hashed(flat)
        owner, starts = doc_of(ends), starts_of(ends)
        gone = np.zeros(len(words), bool)
        fits = np.flatnonzero(inside(ends, window, len(words)))
        if len(fits):
            keys = pair(Grams(words)(window)[fits], owner[fits].astype(U))
            order = np.argsort(keys, kind="stable")
            later = np.concatenate([[False], keys[order][1:] == keys[order][:-1]])
            part = block.column("part")
            size = np.diff(np.asarray(part.offsets)) * ~np.asarray(part.is_null())
            at = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(starts, size)
            stop = np.repeat(ends, size)
            gone = covered(np.concatenate([fits[order[later]], at[at + window <= stop]]), window, len(words))
        own = digests(words, ends)[0].view(np.int64)
        for i, hashes in enumerate(block.column("whole").to_pylist()):
            if hashes and int(own[i]) in hashes and ends[i] - starts[i] >= window:
                gone[starts[i] : ends[i]] = True
        kept = []
        for i, (start, stop) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            own_words = data[offsets[i] : offsets[i + 1]].split()
            if gone[start:stop].any():
                own_words = [own_words[x] for x in np.flatnonzero(~gone[start:stop]).tolist()]
            kept.append(b" ".join(own_words))
        return [pa.array(ends - starts), pa.array(per_doc(gone, ends)), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary()).view(pa.string())]

    return append(texts.join(both, "doc_id", "left"), erase, RESULT).drop("text", "whole", "part")
