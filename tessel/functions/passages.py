"""Chunk windows, titles, snippets and content hashes of notes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def windows(tokens: Column, size: int, overlap: int) -> Column:
    """Array of (chunk, start, stop): windows of ``size`` tokens, each ``overlap`` into the one before; the first that reaches the end is the last."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than the size")
    n, step = F.size(tokens), size - overlap
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step)).cast("int"))
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("chunk"), (i * step).alias("start"), F.least(i * step + size, n).alias("stop")))
    return F.when(n > 0, each).otherwise(F.array().cast("array<struct<chunk:int,start:int,stop:int>>"))


def title(text: Column, fallback: Column) -> Column:
    """The first top-level heading, or else the fallback."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?m)^# (.+)$", 1), F.lit("")), fallback)


def passage(heading: Column, chunk: Column) -> Column:
    return F.concat(heading, F.lit("\n\n"), chunk)


def snippet(text: Column, size: int = 240) -> Column:
    return F.substring(text, 1, size)


def collapsed(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"\s+", " ")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)
