"""Streams of points into a store: every micro-batch is an ingest of its own, once however often it is tried."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import verbs
from ..store import CellStore


def shatter_stream(store: CellStore, points: DataFrame, dates, checkpoint: str, prefix: str = "stream", trigger: dict | None = None) -> StreamingQuery:
    """Start a query that shatters each micro-batch.

    The batch id names the ingest: a batch that is run again after a failure overwrites its own slot.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        name = f"{prefix}-{batch_id}"
        if store.history(name=name):
            verbs.restart(store, batch, name)
        else:
            verbs.shatter(store, batch, verbs.ShatterConfig(dates=dates, name=name, bounds=store.grid.root))

    return points.writeStream.queryName(f"shatter-{uuid.uuid4().hex[:8]}").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
