"""Errors of the vector database."""

from __future__ import annotations


class VectorDbError(Exception):
    """Base of all errors raised here."""


class DatabaseLocked(VectorDbError):
    """Another handle, here or in another process, has the database open."""


class InvalidInput(VectorDbError):
    """A name, number, vector or option that isn't allowed."""


class Corrupt(VectorDbError):
    """Stored data that can't be trusted."""


class StaleCollection(VectorDbError):
    """The handle belongs to a collection that was dropped, or dropped and made anew."""


class Poisoned(VectorDbError):
    """A commit broke off half-way in this process; the database must be opened again."""


class Io(VectorDbError):
    """The file system failed."""


class Kv(VectorDbError):
    """The catalog refused: its capacity is used up."""


class CollectionNotFound(VectorDbError):
    pass


class CollectionAlreadyExists(VectorDbError):
    pass


class UnknownMetric(VectorDbError):
    pass


class DimensionMismatch(VectorDbError):
    def __init__(self, expected: int, got: int) -> None:
        super().__init__(f"expected {expected} dimensions, got {got}")
        self.expected, self.got = expected, got


class BadMagic(Corrupt):
    """A file that isn't of this database's format."""
