"""Continuous indexing: each micro-batch of a stream becomes a committed segment, once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quarry.sources.index import Index


def index_stream(stream: DataFrame, index: Index, name: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start indexing ``stream`` (doc_id and fields). Readers see a batch after ``reload``.

    The commit records the stream's batch number in the snapshot, so that a batch which is run again after a failure
    isn't added twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        if index.meta().streams.get(name, -1) >= number:
            return
        writer = index.writer()
        try:
            writer.add(batch)
            writer.commit({name: number})
        finally:
            writer.close()

    return (
        stream.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .queryName(name)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
