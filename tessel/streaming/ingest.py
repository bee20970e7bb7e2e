"""A stream of vectors into a collection: every micro-batch is one atomic append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessel.db import Collection


def ingest(stream: DataFrame, collection: Collection, checkpoint: str, *, order: str, vector: str = "vector", metadata: str | None = "metadata", **trigger) -> StreamingQuery:
    """Start the query. The manifest records the last batch of each checkpoint folder with the append itself, so one that is
    repeated after a failure between its commit and the checkpoint inserts nothing."""

    def append(batch: DataFrame, number: int) -> None:
        collection.append(batch, order, vector, metadata, once=f"{checkpoint}:{number}")

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
