"""Fuzzy duplicate lines by MinHash, with DataFrame and SQL functions only.

A line's character shingles are the WIDTH characters from each position on (fewer at its end), lower-cased, so every character
counts. Similarity is the Jaccard similarity of two lines' sets of shingles.

1. Signatures are computed where the text is read, without a shuffle. A line's shingles are hashed once each, by one permutation of
   the 64-bit numbers, and sorted; of BANDS points at equal distances on the ring of these numbers, the ROWS hashes that follow a
   point are its band, and a hash of them is a bucket key. A band of two lines agrees if the ROWS least hashes from the point on, of
   all that either has, are in both; so it does with the probability of similarity to the power of ROWS, as with as many
   permutations. Lines of few shingles share hashes between their bands, which fills empty bins.
2. For keys, the shingles are thinned to those that start a word, as long as a line has enough of them; of other lines (short
   ones, long words, scripts without spaces) all shingles count. Lines with FEW to MANY distinct ones get both kinds of keys, so that
   similar lines share a kind.
3. Equal lines become one row with the place of the first. Buckets yield stars, and candidates are confirmed by exact Jaccard similarity on the
   full sets, of all positions (as 32-bit hashes: of 600 shingles two coincide with a probability of 4 in 100,000). What the stars of a bucket of three or more leave apart is compared exactly within the bucket.
4. Connected components (distributed union-find) keep the first line of each.

At a similarity of 0.75 two lines share no bucket with a probability of about 2 in 100 (10 bands of 4), at 0.85 of 1 in 1,600.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.llm.components import components  # noqa: F401  (the union-find that link() uses)
from tessel.llm.native import bound
from tessel.llm.near_dup import link
from tessel.llm.shared import cut, id_and_text, own, release

WIDTH, BANDS, ROWS = 12, 10, 4
#: With FEW distinct shingles that start words or more, these make keys; with fewer than MANY, all shingles do.
FEW, MANY = 12, 20
BLANK = " \t\n\x0b\x0c\r"


def word_starts(width: int) -> str:
    """An expression whose group is the shingle at the start of each word, in a line with a blank put before it."""
    return r"(?s)[\x20\x09-\x0D](?=([^\x20\x09-\x0D].{0,%d}))" % (width - 1)


def wordy(line: Column) -> Column:
    return F.length(F.ltrim(line, F.lit(BLANK))) > 0


def every_shingle(line: Column, width: int, hashed=F.xxhash64) -> Column:
    """Hashes of the distinct shingles at all positions. Four bytes stand for a character, so a place is found by multiplication."""
    each = lambda b: F.transform(F.sequence(F.lit(0), F.shiftright(F.length(b), 2) - 1), lambda i: hashed(F.substr(b, 4 * i + 1, F.lit(4 * width))))
    return F.array_distinct(bound(F.encode(line, "UTF-32"), each))


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a value under a name. As an element of an array that is exploded it is computed once, however often later columns name it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def with_keys(lines: DataFrame, hashes: str, kind: str, bands: int, rows: int) -> DataFrame:
    """lines, of which each has a hash at least, with keys, one for each band; kind (a column of ints) tells keys of different shingles apart.

    Each step is a column of its own, and not a lambda, so that it runs in generated code over plain arrays of longs.
    """
    at = [-(1 << 63) + (b << 64) // bands for b in range(bands)]
    points = F.array(*map(F.lit, at))
    again = F.slice(F.flatten(F.array_repeat(F.slice("_own", 1, rows), rows)), 1, rows)
    lines = once(lines, "_own", F.sort_array(hashes))
    lines = once(once(lines, "_both", F.sort_array(F.concat("_own", points))), "_ring", F.concat(F.col("_own"), again)).drop("_own")
    # A point's place among hashes and points, less the points before it, is the place of the first hash that follows (or is the point's own number).
    key = lambda b: F.xxhash64(F.col(kind) * bands + b, F.slice("_ring", (F.array_position("_both", F.lit(at[b])) - b).cast("int"), F.lit(rows)))
    return lines.withColumn("keys", F.array(*map(key, range(bands)))).drop("_both", "_ring")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, line_no, line) of the lines that hold a word; lines end at \\n and count from 0. text_id is a hash of the whole text."""
    known = id_and_text(docs).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return known.select("doc_id", F.xxhash64("text").alias("text_id"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).where(wordy(F.col("line")))


def signed_lines(docs: DataFrame, *, bands: int = BANDS, rows: int = ROWS, width: int = WIDTH) -> DataFrame:
    """(id, lead, first, keys): distinct lines, the place (doc_id, line_no, text_id) of the first, and bucket keys. A line with both kinds of keys is two
    rows, one of which leads."""
    lines = lines_of(docs).select(F.struct("doc_id", "line_no", "text_id").alias("place"), F.xxhash64("line").alias("id"), F.lower("line").alias("low"))
    # An array that can hold no null: sorting one that can goes by objects and a comparator.
    none = F.array_repeat(F.lit(0).cast("long"), 0)
    found = F.regexp_extract_all(F.concat(F.lit(" "), F.col("low")), F.lit(word_starts(width)), F.lit(1))
    keyed = once(lines, "starts", F.array_distinct(F.transform(found, lambda x: F.xxhash64(x))))
    keyed = once(keyed, "every", F.when(F.size("starts") < MANY, every_shingle(F.col("low"), width)).otherwise(none)).drop("low")
    keyed = once(keyed, "enough", F.when(F.size("starts") >= FEW, F.col("starts")).otherwise(none)).drop("starts")
    keyed = keyed.select("id", "place", (F.size("enough") == 0).alias("short"), F.posexplode(F.array("enough", "every")).alias("kind", "hashes")).where("size(hashes) > 0")
    keyed = with_keys(keyed.withColumn("lead", F.col("short") | (F.col("kind") == 0)).drop("short"), "hashes", "kind", bands, rows)
    return keyed.groupBy("id", "lead").agg(F.min("place").alias("first"), F.any_value("keys").alias("keys"))


def similar_lines(signed: DataFrame, docs: DataFrame, *, percent: int = 75, width: int = WIDTH) -> DataFrame:
    """(id, component) of the lines (see signed_lines) that are linked with another one."""
    # Keys are dealt out once: what counts them and what keeps the shared ones read the same shuffle files.
    banded = signed.select(F.col("id").alias("doc_id"), F.explode("keys").alias("key")).repartition("key")
    shared = banded.groupBy("key").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x <> y").select("key")
    members = cut(banded.join(shared.hint("shuffle_hash"), "key"))
    # The texts of these lines are read from the place of the first, which no other line shares: no key of this join is hot.
    asked = signed.where("lead").select("id", "first").join(members.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")
    places = ["doc_id", "line_no", "text_id"]
    texts = lines_of(docs).withColumn("low", F.lower("line")).select(*places, "low").join(asked.select(F.col("id").alias("own"), "first.*").hint("shuffle_hash"), places).dropDuplicates(["own"])
    sets = cut(texts.select(F.col("own").alias("doc_id"), every_shingle(F.col("low"), width, F.hash).alias("set")).select("doc_id", F.size("set").alias("n"), "set"))
    known = docs.sparkSession.createDataFrame([], "a long, b long")
    parts = link(members, sets, percent, known, by_bucket=True)
    release(members, sets)
    return parts.withColumnRenamed("node", "id")


def kept_lines(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text_id, kept): the numbers of the lines that stay, of documents that keep any: of each component of similar lines the
    first by (doc_id, line number, text_id)."""
    like = {k: options.pop(k) for k in ("percent",) if k in options}
    signed = cut(signed_lines(docs, **options))
    parts = similar_lines(signed, docs, **like, **{k: v for k, v in options.items() if k == "width"})
    placed = signed.where("lead").select("id", "first").join(parts, "id", "left")
    alone = placed.where("component IS NULL").select("first")
    led = placed.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("first")).select("first")
    out = cut(alone.union(led).select("first.*").groupBy("doc_id", "text_id").agg(F.collect_list("line_no").alias("kept")))
    release(signed, parts)
    return out


def _numbers(parts: Column) -> Column:
    """The numbers of the lines that hold a word."""
    return F.filter(F.transform(parts, lambda x, i: F.when(wordy(x), i)), lambda i: i.isNotNull())


def line_dedup(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines (with a word), n_removed, removed_lines (their numbers, ascending).

    Lines are equal if their 64-bit hashes are, and linked when 100 * |A & B| >= percent * |A | B| on their shingle sets. Of each component all but the
    first line (by doc_id, line number and hash of the text) are removed. Lines without a word are never removed, nor those of rows with a null
    doc_id; null and empty texts have none. Rows that repeat doc_id and text are judged alike; of different texts under one doc_id the one with the lesser hash is
    the first. A text or line may be of any length: positions are dealt out in runs. An empty table gives an empty one, and other columns of docs, whatever
    their names, are not read.
    """
    none = F.array().cast("array<int>")
    numbers = id_and_text(docs).select("doc_id", F.xxhash64("text").alias("text_id"), F.coalesce(_numbers(F.split("text", "\n", -1)), none).alias("numbers"))
    both = numbers.join(kept_lines(docs, **options), ["doc_id", "text_id"], "left")
    removed = F.when(F.col("doc_id").isNull(), none).otherwise(F.array_except("numbers", F.coalesce("kept", none)))
    return both.select("doc_id", F.size("numbers").cast("long").alias("n_lines"), removed.alias("removed_lines")).select("doc_id", "n_lines", F.size("removed_lines").cast("long").alias("n_removed"), "removed_lines")


def without_duplicate_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", *, drop_emptied: bool = False, **options) -> DataFrame:
    """docs with the duplicate lines (see line_dedup) taken out of their texts; the other columns stay as they are.

    With drop_emptied, rows go whose text held a word and lost every line that does: all of it stands in other documents. No other row is dropped.
    """
    none = F.array().cast("array<int>")
    kept = kept_lines(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), **options).select(F.col("doc_id").alias("_tessel_doc"), F.col("text_id").alias("_tessel_text"), F.col("kept").alias("_tessel_kept"))
    both = docs.join(kept, (F.col(key).cast("long") == F.col("_tessel_doc")) & (F.xxhash64(F.col(text).cast("string")) == F.col("_tessel_text")), "left")
    parts = F.split(text, "\n", -1)
    numbers = _numbers(parts)
    gone = F.array_except(numbers, F.coalesce("_tessel_kept", none))

    def left(parts: Column) -> Column:
        staying = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.array_except(_numbers(parts), F.coalesce("_tessel_kept", none)))
        return F.array_join(F.transform(staying, lambda i: F.element_at(parts, i + 1)), "\n")

    judged = F.col(key).isNotNull() & (F.size(numbers) > 0)
    if drop_emptied:
        both = both.where(~F.coalesce(judged & F.col("_tessel_kept").isNull(), F.lit(False)))
    return both.withColumn(text, F.when(F.coalesce(judged & (F.size(gone) > 0), F.lit(False)), bound(parts, left)).otherwise(F.col(text))).select(*own(docs))
