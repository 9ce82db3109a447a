"""Append-only ingest of a stream into a collection."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quarry.storage import written


def ingest(stream: DataFrame, collection: Any, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch of a stream with the collection's columns is inserted as a
    whole. A batch that runs again after a failure is skipped where its ids are
    there already, so documents come in once."""

    def batch(df: DataFrame, _: int) -> None:
        key = collection.backend.key
        fresh = df.dropDuplicates([key]).join(collection.frame.select(key), key, "left_anti").select(*df.columns)
        rows = written(fresh)
        if not rows.isEmpty():
            collection.insert_frame(rows)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
