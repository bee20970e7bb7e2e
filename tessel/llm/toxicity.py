"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is logistic in its words and their beginnings; a document is toxic unless none of its sentences is (noisy-or):
P = 1 - prod(1 - p). Both weights and the sentences' scores follow from document labels alone, by gradient ascent on the likelihood.
Training takes a sample of labelled documents that is bounded in rows and in bytes of text (SAMPLE, SAMPLE_BYTES, by hash of the id; whole texts); scoring is one narrow pass over all
documents with a weight table of fixed size (2^BITS floats) broadcast.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.shared import append, id_and_text, tune
from tessel.llm.text import LOWER, U, blocks, hashed, prefixes, raw, split, starts_of

#: Labelled documents that training takes at most.
SAMPLE = 20_000
#: Bytes of text that they hold at most: what the driver gets of them is a few numbers for a word.
SAMPLE_BYTES = 32 << 20
BITS = 18
#: Features that a step of training takes at once.
RUN = 1 << 18
PREFIXES = (5, 6, 7, 8)
FOLDS = 5
#: A sentence ends at . ! ? or a line break; what else is ASCII and no letter or digit parts words.
BREAKS = b".!?\n\r"
FOLD = bytes(0x0A if b in BREAKS else LOWER[b] if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


class Model(NamedTuple):
    weights: np.ndarray
    bias: float


def sentences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features and the sentence of each, which sentences have words, and each text's end among the sentences.

    A word's features are itself and its beginnings of PREFIXES bytes, as inflected words share these.
    """
    offsets, data = raw(texts)
    folded = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(data.translate(FOLD))])
    lists = pc.split_pattern(folded, "\n")
    flat, ends = split(*raw(lists.flatten()))
    owner = np.repeat(np.arange(len(ends)), ends - starts_of(ends))
    begun, word = prefixes(flat, PREFIXES)
    features = (np.concatenate([hashed(flat), begun]) >> U(64 - BITS)).astype(np.int64)
    return features, np.concatenate([owner, owner[word]]), ends > starts_of(ends), np.asarray(lists.offsets)[1:].astype(np.int64)


def sentence_logits(model: Model, features: np.ndarray, owner: np.ndarray, some: np.ndarray) -> np.ndarray:
    return np.where(some, np.bincount(owner, weights=model.weights[features], minlength=len(some)) + model.bias, -np.inf)


def evidence(logits: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """-log of the probability that no sentence is toxic; every document has a sentence, and its sum is its own."""
    return np.add.reduceat(np.logaddexp(0.0, logits), starts_of(ends)) if len(ends) else np.zeros(0)


def slope(w: np.ndarray, b: float, own: np.ndarray, at: np.ndarray, some: np.ndarray, doc: np.ndarray, y: np.ndarray, decay: float) -> tuple[float, np.ndarray]:
    """Loss (the mean negative log-likelihood of the documents' labels, and decay) and its gradient by weights and bias.

    own and at are a feature and its sentence, some tells which sentences have words, doc is the document of each sentence.
    """
    n, runs = len(y), [slice(i, i + RUN) for i in range(0, len(own), RUN)]
    z = np.zeros(len(some))
    for r in runs:
        # A run's sentences follow one another, so its sums are short.
        low = int(at[r].min())
        sums = np.bincount(at[r] - low, weights=w[own[r]])
        z[low : low + len(sums)] += sums
    z = np.clip(z + b, -60, 60, out=z)
    a = np.maximum(np.bincount(doc, weights=np.log1p(np.exp(z)) * some, minlength=n), 1e-9)
    loss = float(((1 - y) * a - y * np.log(-np.expm1(-a))).mean() + decay * (w @ w) / 2)
    g = (some / (1 + np.exp(-z))) * ((1 - y) - y / np.expm1(np.minimum(a, 500)))[doc] / n
    grad = decay * w
    for r in runs:
        grad += np.bincount(own[r], weights=g[at[r]], minlength=len(w))
    return loss, np.append(grad, g.sum())


def fit(features: np.ndarray, owner: np.ndarray, some: np.ndarray, docs: np.ndarray, labels: np.ndarray, use: np.ndarray, *, rounds: int = 120, rate: float = 0.15, decay: float = 5e-5) -> Model:
    """Adam on the noisy-or likelihood; features that ``use`` doesn't mark carry no weight."""
    weights = np.zeros(1 << BITS, np.float32)
    if not len(labels) or not some.any():
        return Model(weights, -20.0)
    doc, chosen = np.repeat(np.arange(len(docs)), docs - starts_of(docs)), np.flatnonzero(use)
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    own = place[features]
    own, at = own[own >= 0], owner[own >= 0].astype(np.int32)
    w, b = np.zeros(len(chosen)), -5.0
    m, v, y = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1), labels.astype(float)
    for t in range(1, rounds + 1):
        _, grad = slope(w, b, own, at, some, doc, y, decay)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    weights[chosen] = w
    return Model(weights, float(b))


def fold_of(key: str = "doc_id"):
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learn from labelled documents outside the held-out fold (crc32 of the id as text, mod 5, is 0). Null labels are left out;
    of several labels of a document the greatest counts, and of several texts of a document all. Documents come in order of a hash of the id, then of the id, until ``sample``
    of them or ``sample_bytes`` of text are taken; one that alone is larger is passed over."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna().where(fold_of() != 0)
    chosen = chosen.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    # The sample's ids are at most ``sample`` rows, whatever the size of the tables.
    known = id_and_text(docs).where("text IS NOT NULL")
    sizes = known.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.sum(F.octet_length("text") + 1).alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    taken, room = [], sample_bytes
    for r in sizes:
        if r["size"] <= room:
            taken.append((r["doc_id"], r["y"]))
            room -= r["size"]
    texts = known.join(F.broadcast(docs.sparkSession.createDataFrame(taken, "doc_id long, y int")), "doc_id")
    use = telling(texts)
    kept = docs.sparkSession.sparkContext.broadcast(use)

    def pack(block: pa.RecordBatch) -> list[pa.Array]:
        features, owner, some, docs = sentences(block.column("text"))
        marked = kept.value[features]
        features, owner = features[marked], owner[marked]
        order = np.argsort(owner, kind="stable")
        counts = np.bincount(owner, minlength=len(some))
        width = np.append(0, np.cumsum(counts))[np.append(0, docs)]
        lists = lambda at, x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32()))
        # A sentence without words counts -1; one with words, but none that tells, 0.
        return [lists(width, features[order]), lists(np.append(0, docs), np.where(some, counts, -1))]

    fields = [T.StructField(x, T.ArrayType(T.IntegerType())) for x in ("features", "counts")]
    got = append(texts, pack, fields).drop("text").toArrow().sort_by("doc_id")
    flat = [got.column(c).combine_chunks() for c in ("features", "counts")]
    features, counts = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int32) for x in flat)
    ends = np.cumsum(pc.list_value_length(flat[1]).to_numpy(zero_copy_only=False).astype(np.int64))
    return fit(features, np.repeat(np.arange(len(counts), dtype=np.int32), np.maximum(counts, 0)), counts >= 0, ends, got.column("y").to_numpy(), use)


def telling(labelled: DataFrame, *, least: int = 5, z: float = 2.0) -> np.ndarray:
    """Which of the 2^BITS features documents of one label have more often than those of the other, beyond chance.

    Counted on the executors; a count for each feature and label reaches the driver, a table of fixed size.
    """

    tune(labelled.sparkSession)

    def count(batches):
        for block in blocks(batches):
            features, owner, _, docs = sentences(block.column("text"))
            doc = np.repeat(np.arange(len(docs)), docs - starts_of(docs))[owner]
            once = np.unique(doc * (1 << BITS) + features)
            y = block.column("y").to_numpy()[once >> BITS] > 0
            got, n = np.unique((once & ((1 << BITS) - 1)) * 2 + y, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(n)], names=["f", "n"])

    sums = labelled.select("text", "y").mapInArrow(count, "f bigint, n bigint").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    total = {bool(r["y"]): r["n"] for r in labelled.groupBy((F.col("y") > 0).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    seen = np.zeros(2 << BITS)
    seen[sums.column("f").to_numpy()] = sums.column("n").to_numpy()
    few, many = seen[::2], seen[1::2]
    n0, n1 = max(1, total.get(False, 0)), max(1, total.get(True, 0))
    p = (few + many + 1) / (n0 + n1 + 2)
    return (few + many >= least) & (np.abs(many / n1 - few / n0) >= z * np.sqrt(p * (1 - p) * (1 / n0 + 1 / n1)))


def apply(docs: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with score, predicted and offending: start, end, ... (code points) of the sentences with a probability of half or more.

    The new columns' names begin with a prefix, for tables that have columns of these names.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def judge(block: pa.RecordBatch) -> list[pa.Array]:
        texts = block.column(text)
        features, owner, some, docs = sentences(texts)
        logits = sentence_logits(Model(*shared.value), features, owner, some)
        score = -np.expm1(-evidence(logits, docs))
        spans: list[list[int]] = [[] for _ in docs]
        for i in np.unique(np.searchsorted(docs, np.flatnonzero(logits >= 0), "right")).tolist():
            first = int(docs[i - 1]) if i else 0
            at = 0
            for k, piece in enumerate(texts[i].as_py().encode().translate(_MARK).split(b"\n")):
                size = len(piece.decode())
                if logits[first + k] >= 0:
                    spans[i] += [at, at + size]
                at += size + 1
        return [pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, pa.list_(pa.int32()))]

    return append(docs, judge, [T.StructField(f"{prefix}score", T.DoubleType()), T.StructField(f"{prefix}predicted", T.IntegerType()), T.StructField(f"{prefix}offending", T.ArrayType(T.IntegerType()))], text)


_MARK = bytes(0x0A if b in BREAKS else b for b in range(256))


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted, offending.

    Null and empty texts score 0; texts of any length are read whole. Without usable labels all scores are near 0. A null doc_id is not held out. Repeated rows are scored
    each on their own and count in training as often as they are there. An empty table gives an empty one, and other columns of docs, whatever their names, are not read.
    offending are the places (start, end, ... in code points) of the sentences with a probability of half or more.
    """
    scored = apply(id_and_text(docs), train(docs, labels, **options))
    return scored.select("doc_id", F.coalesce(fold_of() == 0, F.lit(False)).alias("held_out"), "score", "predicted", "offending")
