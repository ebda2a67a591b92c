"""Streams into a store.

Versions don't hang on the order of arrival, so late rows need no watermark: every micro-batch is one atomic
append. The commit of a batch holds the query's id, which lives in its checkpoint, and the batch's number, so a batch that a
restart delivers again adds nothing, and a new checkpoint is a new query, whose rows are all new.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import Files
from ..store import Store


def ingest(store: Store, rows: DataFrame, checkpoint: str, name: str = "ingest", **trigger) -> StreamingQuery:
    """Appends a stream of (key, ts, value, and op if there) to a store, batch by batch."""

    def write(batch: DataFrame, number: int) -> None:
        query = json.loads(Files(store.spark, checkpoint).read("metadata"))["id"]
        if not batch.isEmpty():
            store.append(batch, stream=(query, number))

    return rows.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()
