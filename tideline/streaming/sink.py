"""A Structured Streaming sink: each micro-batch becomes one revision of a collection, once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tideline.store.repo import Collection


def write_stream(stream: DataFrame, collection: Collection, checkpoint: str, name: str, label_column: str = "label", **trigger) -> StreamingQuery:
    """Writes a stream with a column of labels. Rows of a batch replace those of the same label and index and leave all others, so that batches may interleave in time.

    The number of the last batch is part of the revision that brings its rows: a batch that is repeated after a failure is left out, whenever that came. ``name`` stands for the stream as long as its checkpoint lives. Trigger options go to the writer (e.g. availableNow=True).
    """

    def put(batch: DataFrame, number: int) -> None:
        collection.refresh()
        if dict(collection.manifest().sinks).get(name, -1) < number:
            collection.upsert(batch, label_column, (name, number))

    return stream.writeStream.queryName(name).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
