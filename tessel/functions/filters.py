"""The metadata filter: a top-level field that is an array with a given string in it."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filter:
    """field is a literal key, not a path. Only array elements that are strings match; whatever else the metadata is, it doesn't."""

    field: str
    contains: str

    def column(self, metadata: str = "metadata") -> Column:
        """The predicate on a column of JSON texts; never null, never an error."""
        if any(c in self.field for c in "\"'\\[]"):
            keys = F.from_json(metadata, "map<string,string>", {"mode": "PERMISSIVE"})
            inner = F.try_parse_json(F.try_element_at(keys, F.lit(self.field)))
            items = F.try_variant_get(inner, "$", "array<variant>")
        else:
            items = F.try_variant_get(F.try_parse_json(metadata), f'$["{self.field}"]', "array<variant>")
        return F.coalesce(F.exists(items, lambda x: (F.schema_of_variant(x) == "STRING") & (F.try_variant_get(x, "$", "string") == self.contains)), F.lit(False))

    def matches(self, metadata) -> bool:
        """The same on a parsed value."""
        items = metadata.get(self.field) if isinstance(metadata, dict) else None
        return isinstance(items, list) and any(isinstance(x, str) and x == self.contains for x in items)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Filter:
        return cls(**json.loads(text))


def canonical(value) -> str:
    """JSON text for a metadata value; of keys that repeat the last was kept when it was parsed."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False, allow_nan=False)
