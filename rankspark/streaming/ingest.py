"""Streaming documents into an index, one segment per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.index import Index


def stream_into(index: Index, documents: DataFrame, checkpoint: str, first_segment: int | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Start writing a stream of ``(doc_id, text[, field])`` into ``index``.

    The segment number follows from the batch number and writing a segment
    replaces it, so a batch that is replayed after a failure is not counted
    twice. Unless ``first_segment`` is given, the stream gets numbers of its own,
    known by its ``checkpoint``, and adds to what the index holds already. By
    default the available input is read and the query ends.
    """
    if first_segment is None:
        first_segment = index.stream_start(checkpoint)

    def write(batch: DataFrame, batch_id: int) -> None:
        # A batch that is replayed may have been merged with others meanwhile.
        if not index.was_merged(first_segment + batch_id):
            index.append(batch, first_segment + batch_id)

    return (
        documents.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
