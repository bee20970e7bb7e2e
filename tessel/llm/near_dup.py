"""Near-duplicate documents: MinHash by one-permutation hashing, banded buckets, star-shaped candidates, exact confirmation.

One pass over the texts hashes each document's distinct word shingles once. The hashes are dealt into BINS bins by their top
bits and the least of each bin is kept; an empty bin borrows from another, found by a hash of the bin and the attempt alone
(optimal densification), so two documents probe the same bins. Documents with equal sets form a class, by a 128-bit digest
of the set, and only the least document of a class goes on: thousands of copies are one row from there.

Bands of ROWS bins are bucket keys. A bucket of m documents yields m - 1 candidates, from its least document to each other.
Candidates are confirmed on the full shingle sets. Two documents may miss each other in a star when neither is the hub; so
clusters of candidates that hold several components after this are settled exactly, in blocks (see link()). At a
similarity of 0.75 a pair shares no bucket with a probability of about 5 in a million (32 bands of 4).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.components import components, graph_components
from tessel.llm.shared import append, cut, first_row, id_and_text, release, with_first
from tessel.llm.text import LOWER, Grams, U, doc_of, hashed, inside, mix, pair, per_doc, raw, split, starts_of

BINS, ROWS = 128, 4
#: Members of a cluster in a block, on average; and of a bucket, and guests in one.
BLOCK, BUCKET_BLOCK = 32, 256
#: In the first round a guest of a bucket meets so many members, in each further one so many times more.
SAMPLE = 16
#: Longs of 64 bits that stand for a set: enough that those of a line of several hundred characters are far from full.
MASKS = 16

LONG = T.LongType()


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and each text's end among them."""
    offsets, data = raw(texts)
    flat, ends = split(offsets, data.translate(LOWER))
    words = hashed(flat)
    grams, docs, starts = Grams(words), doc_of(ends), starts_of(ends)
    at = np.flatnonzero(inside(ends, size, len(words)))
    keys, owner = [grams(size)[at]], [docs[at]]
    for n in range(1, size):
        short = np.flatnonzero(ends - starts == n)
        if len(short):
            keys.append(grams.at(n, starts[short]))
            owner.append(short)
    key, own = np.concatenate(keys), np.concatenate(owner)
    order = np.lexsort((key, own))
    key, own = key[order], own[order]
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    key, own = key[first], own[first]
    return key, np.cumsum(np.bincount(own, minlength=len(texts)))


def densified(key: np.ndarray, ends: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation signatures (a row for each document); documents without shingles keep the largest value."""
    none = U(0xFFFFFFFFFFFFFFFF)
    out = np.full((len(ends), bins), none, U)
    where = (key >> U(64 - (bins - 1).bit_length())).astype(np.int64)
    owner = doc_of(ends)
    first = np.ones(len(key), bool)
    first[1:] = (where[1:] != where[:-1]) | (owner[1:] != owner[:-1])
    out[owner[first], where[first]] = key[first]
    full = np.zeros((len(ends), bins), bool)
    full[owner, where] = True
    doc, empty = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 0
    while len(doc):
        attempt += 1
        probe = (mix(empty.astype(U) * U(0x10001) + U(attempt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % U(bins)).astype(np.int64)
        ok = full[doc, probe]
        out[doc[ok], empty[ok]] = out[doc[ok], probe[ok]]
        doc, empty = doc[~ok], empty[~ok]
    return out


def signatures(docs: DataFrame, size: int, bins: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (set_a, set_b) and bands; nothing is shuffled."""

    def sign(block: pa.RecordBatch) -> list[pa.Array]:
        key, ends = shingles(block.column("text"), size)
        n = ends - starts_of(ends)
        total = [np.concatenate([np.zeros(1, U), np.cumsum(mix(key ^ U(seed)), dtype=U)]) for seed in (0x1D8E4E27C47D124F, 0x72BE1F4B9C1A3D55)]
        digest = [(t[ends] - t[starts_of(ends)]).view(np.int64) for t in total]
        sketch = densified(key, ends, bins)
        bands = np.empty((len(ends), bins // rows), U)
        for b in range(bins // rows):
            own = np.full(len(ends), U(b + 1))
            for r in range(rows):
                own = pair(own, sketch[:, b * rows + r])
            bands[:, b] = own
        width = np.where(n > 0, bands.shape[1], 0)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(width)), pa.int32()), pa.array(bands[n > 0].ravel().view(np.int64)))
        return [pa.array(n.astype(np.int64)), *map(pa.array, digest), lists]

    return append(docs, sign, [T.StructField("n_shingles", LONG), T.StructField("set_a", LONG), T.StructField("set_b", LONG), T.StructField("bands", T.ArrayType(LONG))]).drop("text")


#: Into so many parts a hub's candidates are dealt, so that no task has to meet all of them.
SPREAD = 256


def confirmed(candidates: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The candidates (a, b), each there once, whose full sets are similar enough.

    Sizes (n) come first: pairs whose sizes alone rule the similarity out never meet a set. A hub's set goes once to each part of its candidates.
    """
    size = lambda x: sets.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"))
    sized = candidates.join(size("b"), "b").join(size("a"), "a").where(percent * F.greatest("n_a", "n_b") <= 100 * F.least("n_a", "n_b"))
    dealt = sized.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(SPREAD)))
    hubs = dealt.select("a", "part").distinct().join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")), "a")
    both = dealt.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b")), "b").join(hubs, ["a", "part"])
    return both.where((100 + percent) * F.size(F.array_intersect("set_a", "set_b")) >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def bit_of(x: Column, i: int, other: Column) -> Column:
    """The bit of an element in the i-th long of a mask, by its lowest bits; other, if it is in another long."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)))
    return F.when(F.shiftright(x, 6).bitwiseAND(F.lit(MASKS - 1)) == i, bit).otherwise(other)


def masked(sets: Column) -> Column:
    """A set (array of ints) as MASKS longs: an element is one bit, by its lowest bits."""
    none = F.lit(0).cast("long")
    word = lambda i: F.aggregate(sets, none, lambda m, x: m.bitwiseOR(bit_of(x, i, none)))
    return F.array(*map(word, range(MASKS)))


def masks_of(sets: DataFrame) -> DataFrame:
    """(node, mask) of sets (doc_id, set): what masked() makes, by an aggregation, which runs in generated code."""
    none = F.lit(0).cast("long")
    each = sets.select(F.col("doc_id").alias("node"), F.explode_outer("set").alias("x"))
    words = each.groupBy("node").agg(*(F.bit_or(bit_of(F.col("x"), i, none)).alias(f"m{i}") for i in range(MASKS)))
    return words.select("node", F.array(*(F.col(f"m{i}") for i in range(MASKS))).alias("mask"))


def only_in(a: Column | list[Column], b: Column | list[Column]) -> Column:
    """At least so many elements of a set are not in another one, by their masks: a bit that only one has stands for an element that only it has."""
    return sum((F.bit_count(a[i].bitwiseAND(F.bitwise_not(b[i]))) for i in range(1, MASKS)), F.bit_count(a[0].bitwiseAND(F.bitwise_not(b[0]))))


def link(members: DataFrame, sets: DataFrame, percent: int, known: DataFrame, block: int | None = None, by_bucket: bool = False) -> DataFrame:
    """(node, component) from bucket members (key, doc_id), their sets (doc_id, n, set) with sizes, and known links (a, b).

    With ``by_bucket``, every bucket of three and more is a cluster of its own: where bucket keys are loose, as those of lines, chains
    of chance meetings would else grow into one cluster. Buckets of the same members are settled once.

    Stars first. The candidates of buckets of three and more, confirmed or not, tie documents into clusters; a cluster that the confirmed ones leave in
    several components is settled exactly: each member outside its largest component (a guest) is compared with all members
    of other components. Members are dealt into blocks and a guest goes once to each block, so no pair is ever a row unless it is a link. Guests of a bucket are
    dealt into blocks too, which members go to: rows grow with guests times members over the size of a block, and what a task compares is bounded.
    Sets of buckets (ints) have masks, whose bits rule most pairs out before the sets are met.

    Of buckets links would be rows by the square of a group of near copies. So buckets are settled in rounds: a guest meets a few members (dealt
    apart from guests, so that who meets whom is as good as chance), what is linked becomes one component, and the next round's guests meet SAMPLE times as many.
    Few links then lead out of a component that a round has left, and a bucket is done with the round in which each guest has met all members.
    """
    block = block or (BUCKET_BLOCK if by_bucket else BLOCK)
    star = members.groupBy("key").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("m"))
    # A bucket of two is settled by its one candidate; only larger ones can hide a link, and tie their members into a cluster.
    pairs = members.join(star, "key").where("doc_id <> a").groupBy("a", F.col("doc_id").alias("b")).agg((F.max("m") > 2).alias("tie"))
    pairs = cut(pairs)
    linked = cut(confirmed(pairs.select("a", "b"), sets, percent).union(known))
    if by_bucket:
        both = cut(graph_components(linked.select(F.lit(0).alias("g"), "a", "b")))
        alike = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), *(F.bit_xor(F.xxhash64("doc_id", F.lit(i))).alias(f"d{i}") for i in (1, 2))).where("m > 2")
        clusters = members.join(alike.groupBy("m", "d1", "d2").agg(F.min("key").alias("key")).select("key"), "key").select(F.col("doc_id").alias("node"), F.col("key").alias("cluster"))
    else:
        ties = pairs.where("tie").select("a", "b")
        both = linked.select(F.lit(0).alias("g"), "a", "b").union(ties.select(F.lit(1).alias("g"), "a", "b"))
        both = cut(graph_components(both))
        clusters = both.where("g = 1").select("node", F.col("component").alias("cluster"))
    parts = both.where("g = 0").drop("g")
    rows = clusters.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # What is left to join are whole components, by the least node of each.
    merged, reach, seed = None, SAMPLE if by_bucket else None, 2
    wide = in_blocks(rows, block, reach).join(sets.select(F.col("doc_id").alias("node"), "set"), "node")
    wide = cut(wide.join(masks_of(sets), "node") if by_bucket else wide.withColumn("mask", F.lit(None).cast("array<bigint>")))
    while True:
        most = first_row(wide.agg(F.max("n")))[0]
        if most is None and merged is not None:
            release(wide)
            break
        found = meet(wide, percent, seed, masks=by_bucket).distinct()
        last, merged = merged, cut(components((found if merged is None else found.union(merged)).toDF("a", "b")).toDF("component", "above"))
        if not reach or (most or 0) <= reach:
            release(wide, *([last] if last else []))
            break
        # Sets and masks go from round to round with the members that are left, and never come from the whole table again.
        open_ = wide.where(F.col("n") > reach)
        rows = open_.select("cluster", "node", "component").join(merged, "component", "left")
        rows = cut(rows.select("cluster", "node", F.coalesce("above", "component").alias("component")))
        reach, seed = reach * SAMPLE, seed + 1
        old, wide = wide, cut(in_blocks(rows, block, reach).join(open_.select("cluster", "node", "set", "mask"), ["cluster", "node"]))
        release(old, rows, *([last] if last else []))
    out = cut(parts.join(merged, "component", "left").select("node", F.coalesce("above", "component").alias("component")).union(merged.select("component", "above")).distinct())
    release(pairs, linked, both, merged)
    return out


def in_blocks(rows: DataFrame, block: int, reach: int | None) -> DataFrame:
    """rows (cluster, node, component) of the clusters of several components, with the largest one (home), their members (n), the blocks they are dealt into (of),
    how many of these a guest goes to (blocks: all, or those that hold ``reach`` members), and the blocks of a block's guests (sides)."""
    size = min(block, reach or block)
    counts = rows.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("home"), F.sum("n").alias("all"), F.max("n").alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    mixed = mixed.select("cluster", "home", F.col("all").alias("n"), (F.col("all") - F.col("most")).alias("guests"), F.ceil(F.col("all") / F.lit(size)).alias("of"))
    mixed = mixed.withColumn("blocks", F.least("of", F.lit(-(-reach // size)).cast("long")) if reach else F.col("of"))
    sides = F.ceil(F.col("guests") * F.col("blocks") / F.col("of") / F.lit(block)) if reach else F.lit(1).cast("long")
    return rows.join(mixed.withColumn("sides", sides).drop("guests"), "cluster")


def meet(wide: DataFrame, percent: int, seed: int, masks: bool) -> DataFrame:
    """(own, theirs): the components of each guest and member (see in_blocks()) that met and are similar enough."""
    part, each = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)), lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    words = lambda x: [F.col("mask")[i].alias(f"{x}{i}") for i in range(MASKS if masks else 0)]
    dealt = wide.select("cluster", part("of", 0).alias("turn"), each("sides").alias("side"), F.col("component").alias("theirs"), F.col("set").alias("set_b"), *words("mask_b"))
    guests = wide.where("component <> home").select("cluster", part("sides", 1).alias("side"), part("of", seed).alias("from"), "of", F.col("component").alias("own"), F.col("set").alias("mine"), *words("mask_a"), each("blocks").alias("turn"))
    guests = guests.withColumn("turn", F.pmod(F.col("from") + F.col("turn"), F.col("of"))).drop("from", "of")
    # Similarity is a condition of the join itself: it is computed in generated code, and only links leave the join.
    most, least = F.greatest(F.size("mine"), F.size("set_b")), F.least(F.size("mine"), F.size("set_b"))
    enough = lambda common: (100 + percent) * common >= percent * (most + least)
    alike = percent * most <= 100 * least
    if masks:
        a, b = ([F.col(f"{x}{i}") for i in range(MASKS)] for x in ("mask_a", "mask_b"))
        alike = alike & enough(F.size("mine") - only_in(a, b)) & enough(F.size("set_b") - only_in(b, a))
    alike = alike & enough(F.size(F.array_intersect("mine", "set_b")))
    left, right = guests.alias("l"), dealt.alias("r")
    met = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("cluster", "turn", "side")]
    return left.join(right, met[0] & met[1] & met[2] & (F.col("own") != F.col("theirs")) & alike).select("own", "theirs")


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 75, bins: int = BINS, rows: int = ROWS) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * |A & B| >= percent * |A | B| on their sets of distinct ``size``-word shingles (A-Z
    lower-cased; the whole sequence if shorter); a component is what links reach and its id the least doc_id. Null and empty
    texts are linked with nothing. Rows that share a doc_id are one node. A null doc_id is a component of its own (null) and kept.
    """
    texts = id_and_text(docs)
    signed = cut(signatures(texts, size, bins, rows))
    live = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    key = ["n_shingles", "set_a", "set_b"]
    copied = with_first(live, key).select(*key, "doc_id", "first").distinct()
    classed = cut(live.join(copied, [*key, "doc_id"], "left").select("doc_id", F.coalesce("first", "doc_id").alias("rep"), "bands"))
    banded = classed.where("doc_id = rep").select("doc_id", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x <> y").select("key")
    members = cut(banded.join(shared, "key"))

    def full(block: pa.RecordBatch) -> list[pa.Array]:
        keys, ends = shingles(block.column("text"), size)
        return [pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(keys.view(np.int64)))]

    asked = members.select("doc_id").distinct()
    sets = cut(append(texts.join(asked, "doc_id", "left_semi"), full, [T.StructField("set", T.ArrayType(LONG))]).select("doc_id", F.size("set").alias("n"), "set"))
    # A doc_id with several texts joins their classes.
    twice = classed.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z")
    parts = link(members, sets, percent, twice.join(classed, "doc_id").select("a", F.col("rep").alias("b")).distinct())
    named = classed.select("doc_id", "rep").distinct().join(parts.withColumnRenamed("node", "rep"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    named = cut(named)
    release(members, sets, classed, parts)
    out = signed.select("doc_id", "n_shingles").join(named, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
