"""Validation of names, dimensions and vectors."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.errors import DimensionMismatch, InvalidInput

NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9_-]{0,127}")
MAX_DIM = 65_536


def name(value: str) -> str:
    if not isinstance(value, str) or not NAME.fullmatch(value):
        raise InvalidInput(f"collection name {value!r}")
    return value


def dim(value: int) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or not 1 <= value <= MAX_DIM:
        raise InvalidInput(f"dimension {value!r}")
    return value


def vector(values: Sequence[float], size: int) -> None:
    """Length first, then finiteness."""
    if len(values) != size:
        raise DimensionMismatch(size, len(values))
    if not all(math.isfinite(x) and abs(x) <= 3.4028235677973366e38 for x in values):
        raise InvalidInput("vector elements must be finite")


def finite(v: str | Column) -> Column:
    return F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))


def vector_flags(rows: DataFrame, size: int, column: str = "vector") -> DataFrame:
    """rows with length_ok and finite_ok; both must hold for a row to be stored."""
    return rows.withColumns({"length_ok": F.size(column) == size, "finite_ok": finite(column)})


def vectors(rows: DataFrame, size: int, order: str, column: str = "vector") -> None:
    """One job over all rows; the first offender by ``order`` decides the error."""
    bad = vector_flags(rows, size, column).where("NOT coalesce(length_ok AND finite_ok, false)")
    first = bad.orderBy(order).select(F.size(column), "length_ok").first()
    if first is not None:
        raise InvalidInput("vector elements must be finite") if first[1] else DimensionMismatch(size, first[0])
