"""Repetition inside a document, by suffix arrays.

The suffixes of all documents of a block are sorted together by prefix doubling: ranks of the first 2^k words give ranks of
the first 2^(k+1), and only suffixes that still tie are sorted again. A word counts as another word in another document, so
suffixes of different documents never tie. The ranks of every level give the longest common prefix (LCP) of neighbours in the
array by binary descent. The LCP intervals are the repeated substrings: the deepest interval that holds a suffix gives the
longest repeat that starts there, and it is maximal to the left unless the suffix one word earlier repeats one word longer.

Blocks hold about 2 MB of text (or one longer document), so memory is bounded by the longest document; nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessel.llm.shared import append, id_and_text
from tessel.llm.text import SPACE, U, covered, doc_of, hashed, mix, per_doc, raw, split

#: Bytes that are no code point of their own (continuations) or no part of a word.
NOT_WORD_CHARS = SPACE + bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"

FIELDS = [
    *(T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("kept", T.BooleanType()),
    T.StructField("repeat_covered", T.LongType()),
    T.StructField("longest_repeat", T.LongType()),
    T.StructField("n_maximal_repeats", T.LongType()),
]


def suffix_ranks(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array, and for each k the rank of each suffix by its first 2^k words (equal ranks: equal words)."""
    n = len(words)
    docs = doc_of(ends)
    stop = ends[docs]
    keys = mix(words + mix(docs.astype(U) + U(1)))
    order = np.argsort(keys, kind="stable")
    rank = _ranks(n, order, np.arange(n), keys[order][1:] != keys[order][:-1])
    levels, step = [rank], 1
    while True:
        slots = _tied(rank[order])
        if not len(slots):
            return order, levels
        live = order[slots]
        after = live + step
        second = np.where(after < stop[live], rank[np.minimum(after, n - 1)], -1)
        first = rank[live]
        by = np.lexsort((second, first))
        live, first, second = live[by], first[by], second[by]
        order = order.copy()
        order[slots] = live
        rank = rank.copy()
        new = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank[live] = slots[np.maximum.accumulate(np.where(np.concatenate([[True], new]), np.arange(len(live)), 0))]
        levels.append(rank)
        step *= 2


def _ranks(n: int, order: np.ndarray, slots: np.ndarray, new: np.ndarray) -> np.ndarray:
    rank = np.empty(n, np.int64)
    rank[order] = slots[np.maximum.accumulate(np.where(np.concatenate([[True], new]), np.arange(n), 0))] if n else slots
    return rank


def _tied(ranks: np.ndarray) -> np.ndarray:
    """Slots of the suffix array whose suffixes share their rank."""
    same = ranks[1:] == ranks[:-1]
    tied = np.zeros(len(ranks), bool)
    tied[1:] |= same
    tied[:-1] |= same
    return np.flatnonzero(tied)


def lcp(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Words that each suffix of the array has in common with the one before it."""
    n = len(order)
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(levels[0][order][1:] == levels[0][order][:-1]) + 1
    a, b, got = order[live - 1].copy(), order[live].copy(), np.zeros(len(live), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok = (a < n) & (b < n)
        same = np.zeros(len(live), bool)
        same[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        hop = same * (1 << k)
        a, b, got = a + hop, b + hop, got + hop
    out[live] = got
    return out


def repeats(words: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each word, the length of the longest substring that starts there and occurs twice or more in its document."""
    if not len(words):
        return np.zeros(0, np.int64), [np.zeros(0, np.int64)]
    order, levels = suffix_ranks(words, ends)
    common = lcp(order, levels)
    deepest = np.maximum(common, np.append(common[1:], 0))
    out = np.empty(len(words), np.int64)
    out[order] = deepest
    return out, levels


def repetition(docs: DataFrame, *, window: int = 8, min_words: int = 20, max_repeat: float = 0.30, min_repeat: int = 6, max_covered: float = 0.30, max_longest: float = 0.20) -> DataFrame:
    """Counts and verdicts on repetition, one row for each row of docs (doc_id, text).

    base_failed: fewer than min_words words, or more than max_repeat of them in windows of ``window`` words that recur.
    kept: not base_failed, at most max_covered of the words in maximal repeats of min_repeat words or more, and none of these
    longer than max_longest of the words. Null and empty texts have no words and fail the base. A repeated row gets a row each.
    """

    def measure(block: pa.RecordBatch) -> list[pa.Array]:
        offsets, data = raw(block.column("text"))
        flat, ends = split(offsets, data)
        words = hashed(flat)
        n = per_doc(np.ones(len(words), np.int64), ends)
        texts = [data[i:j] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        chars = [len(x.translate(None, NOT_WORD_CHARS)) for x in texts]
        symbols = [len(x) - len(x.translate(None, SYMBOLS)) for x in texts]
        lines = [[y for y in x.split(b"\n") if y.strip(SPACE)] for x in texts]
        longest, levels = repeats(words, ends)
        level = window.bit_length() - 1
        if window == 1 << level:
            ranks = levels[min(level, len(levels) - 1)] if level < len(levels) else np.arange(len(words))
            again = np.bincount(ranks, minlength=len(words))[ranks] > 1
        else:
            again = longest >= window
        repeated = per_doc(covered(np.flatnonzero(again), window, len(words)), ends)
        long = longest >= min_repeat
        maximal = long & (np.append(0, longest[:-1]) != longest + 1)  # else the suffix before it repeats with one word more
        at = np.flatnonzero(maximal)
        share = per_doc(covered(at, longest[at], len(words)), ends)
        top = np.zeros(len(ends), np.int64)
        np.maximum.at(top, doc_of(ends)[at], longest[at])
        failed = (n < min_words) | (repeated > max_repeat * n)
        kept = ~failed & (share <= max_covered * n) & (top <= max_longest * n)
        return [*map(pa.array, (n, np.array(chars, np.int64), np.array(symbols, np.int64), np.array([len(x) - len(set(x)) for x in lines], np.int64), repeated, failed, kept, share, top, per_doc(maximal, ends)))]

    return append(id_and_text(docs), measure, FIELDS).drop("text")
