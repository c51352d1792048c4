"""Newline-delimited JSON files into a store, as they arrive."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from eventloom.sources import store
from eventloom.sources.documents import assemble


def follow(spark: SparkSession, source: str, root: str, checkpoint: str, promote: Sequence[str] = (), available_now: bool = False, **options) -> StreamingQuery:
    """Write each micro-batch of new files below source to the store at root.

    Faulty documents are left out by default, as one would stop the stream for good. A micro-batch
    is a batch of the store by the name of the stream and its number, so one that is run again after
    a failure replaces what it has written before.
    """
    lines = spark.readStream.text(source)
    docs = assemble(lines, **({"on_error": "skip"} | options))
    stream = hashlib.sha256(f"{source} {checkpoint}".encode()).hexdigest()[:12]

    def put(batch: DataFrame, number: int) -> None:
        store.write(batch, root, promote, batch=f"{stream}-{number}")

    writer = docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="5 seconds")).start()
