"""Incremental ingest: each micro-batch of files becomes the next deltas and revision of a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cairn.plans.pipelines import Catalog, add


def ingest(files: DataFrame, catalog: Catalog, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Start a stream of files (path, content, and modified if there is one) into the catalog. A batch that is run again writes
    no block twice. Of a batch's rows of one path the last by `modified` counts (by content hash without it); all contents are kept."""
    order = "modified" if "modified" in files.columns else None

    def one(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            add(catalog, batch, order=order)

    writer = files.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
