"""Ingest of an event stream into the hashed store, and into the retrieval index.

A replayed micro-batch changes nothing: the store takes each id, a hash of scope, ids and text, once,
and the index each batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators import hashed, index
from quillon.plans.settings import Hashed, Retrieval


def distinct_rows(stream: DataFrame, settings: Hashed = Hashed(), lateness: str = "10 minutes", tools: bool = True) -> DataFrame:
    """Store rows of an event stream, each id once while ``lateness`` has not passed; adds event_time."""
    rows = hashed.rows(stream, settings, tools).withColumn("event_time", F.timestamp_seconds("created_at"))
    return rows.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(["id"])


def start(stream: DataFrame, settings: Hashed, checkpoint: str, tools: bool = True, **trigger) -> StreamingQuery:
    """Write an event stream to the store, micro-batch by micro-batch; trigger: as DataStreamWriter.trigger takes it."""

    def write(batch: DataFrame, _: int) -> None:
        hashed.store(batch, settings, tools)

    return _run(stream, write, checkpoint, trigger)


def start_index(stream: DataFrame, path: str, checkpoint: str, settings: Retrieval = Retrieval(), order: str = "seq", tools: bool = True, **trigger) -> StreamingQuery:
    """Append an event stream to the index at path; micro-batches are numbered on in their order, each by ``order``."""

    def write(batch: DataFrame, number: int) -> None:
        index.append(path, batch, settings, order, tools, batch=number + 1)

    return _run(stream, write, checkpoint, trigger)


def _run(stream: DataFrame, write, checkpoint: str, trigger: dict) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
