"""Words of whole texts as arrays: splitting, hashing and sliding windows over many documents at once.

A block is a run of documents whose texts are split together. Everything below works on a block's words in one array
``words`` (64-bit hashes) with ``ends``, the index just behind each document's last word; no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are split together. A longer text is a block of its own.
BLOCK_BYTES = 2 << 20
#: Words beyond so many bytes are hashed one by one.
LONG_WORD = 512

U = np.uint64
SPACE = bytes(range(0x09, 0x0E)) + b" "
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hashes of its two parts; the order counts."""
    return mix(a * U(0x9E3779B97F4A7C15) + b * U(0xC2B2AE3D27D4EB4F) + U(0x165667B19E3779F9))


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Each batch in slices of at most ``limit`` bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(sizes)])
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(total, total[start] + limit, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def raw(texts: pa.Array) -> tuple[np.ndarray, bytes]:
    """Offsets (from 0) and UTF-8 bytes of a string array; nulls are empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(1, np.int32), b""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = data[int(at[0]) : int(at[-1])].to_pybytes() if data is not None else b""
    return at - at[0], data


def split(offsets: np.ndarray, data: bytes) -> tuple[pa.Array, np.ndarray]:
    """Words separated by bytes 09-0D and 20, and each document's end among them."""
    texts = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(data)])
    lists = pc.ascii_split_whitespace(texts)
    flat, ends = lists.flatten(), np.asarray(lists.offsets)[1:].astype(np.int64)
    full = np.diff(np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]) > 0 if len(flat) else np.zeros(0, bool)
    if not full.all():
        seen = np.concatenate([[0], np.cumsum(full)])
        flat, ends = flat.filter(pa.array(full)), seen[ends]
    return flat, ends


def hashed(words: pa.Array) -> np.ndarray:
    """64-bit hashes of whole words, eight bytes at a time over all words at once."""
    n = len(words)
    if not n:
        return np.zeros(0, U)
    at, data = raw(words)
    at = at.astype(np.int64)
    size = np.diff(at)
    padded = np.frombuffer(data + bytes(16), np.uint8)
    eight = np.ndarray((len(data) + 8,), "<u8", padded.data, strides=(1,))
    out = mix(size.astype(U) + U(0x27D4EB2F165667C5))
    live, k = np.arange(n), 0
    while len(live):
        left = size[live] - k
        live, left = live[left > 0], left[left > 0]
        if k >= LONG_WORD:
            for i in live:
                out[i] = xxhash.xxh3_64_intdigest(data[at[i] : at[i + 1]])
            break
        lane = eight[at[live] + k] & _MASKS[np.minimum(left, 8)]
        out[live] = mix((out[live] ^ lane) * U(0x9E3779B97F4A7C15) + U(k + 1))
        k += 8
    return out


def prefixes(words: pa.Array, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first bytes of each word, for each size below the word's own (at most 8), and the word of each."""
    at, data = raw(words)
    at = at.astype(np.int64)
    size = np.diff(at)
    padded = np.frombuffer(data + bytes(16), np.uint8)
    eight = np.ndarray((len(data) + 8,), "<u8", padded.data, strides=(1,))[at[:-1]]
    owner = [np.flatnonzero(size > n) for n in sizes]
    return np.concatenate([mix((eight[w] & _MASKS[n]) * U(16) + U(n)) for n, w in zip(sizes, owner, strict=True)]), np.concatenate(owner)


class Grams:
    """Hashes of the word sequences of any length that start at each position; made from halves and kept."""

    def __init__(self, words: np.ndarray) -> None:
        self.kept = {1: words}

    def __call__(self, size: int) -> np.ndarray:
        """Of windows of ``size`` words; the last size - 1 positions, where the block ends, are cut off."""
        if size not in self.kept:
            half = 1 << (size - 1).bit_length() - 1
            left, right = self(half), self(size - half)
            n = max(0, len(self.kept[1]) - size + 1)
            self.kept[size] = pair(left[:n], right[half : half + n])
        return self.kept[size]

    def at(self, size: int, where: np.ndarray) -> np.ndarray:
        """The same at chosen positions, without the whole array."""
        if size in self.kept:
            return self.kept[size][where]
        half = 1 << (size - 1).bit_length() - 1
        return pair(self.at(half, where), self.at(size - half, where + half))


def starts_of(ends: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else np.zeros(0, np.int64)


def inside(ends: np.ndarray, size: int, total: int) -> np.ndarray:
    """Which of the positions 0 .. total - size hold a window that stays in its document."""
    n = max(0, total - size + 1)
    ok = np.zeros(total + 1, np.int32)
    starts = starts_of(ends)
    fits = ends - starts >= size
    np.add.at(ok, starts[fits], 1)
    np.add.at(ok, ends[fits] - size + 1, -1)
    return np.cumsum(ok)[:n] > 0


def sliding(values: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """Minimum (or maximum) of each run of ``width`` values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = best(out[: len(out) - step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def covered(at: np.ndarray, size: int | np.ndarray, total: int) -> np.ndarray:
    """Which words lie in a window of ``size`` words that starts at one of ``at``."""
    edge = np.bincount(at, minlength=total + 1)[: total + 1] - np.bincount(at + size, minlength=total + 1)[: total + 1]
    return np.cumsum(edge)[:total] > 0


def per_doc(marks: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of marks in each document."""
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return total[ends] - total[starts_of(ends)]


def doc_of(ends: np.ndarray) -> np.ndarray:
    """The document of each word."""
    return np.repeat(np.arange(len(ends)), ends - starts_of(ends))
