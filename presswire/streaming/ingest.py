"""Streaming ingest: landed feed files to day-partitioned tables.

Each micro-batch runs the batch operators. The append skips stored ids, so a batch that is
replayed after a failure adds nothing twice.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from presswire.operators import quality
from presswire.operators.ingest import extract_headlines, parse_gkg
from presswire.sources import feeds, tables

EVERY = "15 minutes"
# a day of quarter-hour files: a backlog is loaded in batches of bounded size
FILES_PER_BATCH = 96
Reporter = Callable[[DataFrame, int], None]


def _feed_stream(spark: SparkSession, in_dir: str, schema, files_per_batch: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema).options(**feeds.CSV_OPTIONS)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.csv(in_dir)


def _start(stream: DataFrame, load: Reporter, checkpoint: str, once: bool):
    writer = stream.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=EVERY)).start()


def stream_ingest_events(
    spark: SparkSession,
    in_dir: str,
    table: str,
    checkpoint: str,
    once: bool = True,
    files_per_batch: int | None = FILES_PER_BATCH,
    report: Reporter | None = None,
):
    """Event feed directory to the events table. `report` receives each batch's quality
    report; a failed gate does not stop the load.

    An event is stored with the articles of the batch it first comes in; later batches do
    not change it.
    """

    def load(batch: DataFrame, batch_id: int) -> None:
        raw = feeds.type_event_columns(batch)
        if report is not None:
            report(quality.dq_report(raw), batch_id)
        best = extract_headlines(raw).persist(StorageLevel.MEMORY_AND_DISK)  # an append reads its batch twice
        try:
            tables.append_new_events(best, table)
        finally:
            best.unpersist()

    return _start(_feed_stream(spark, in_dir, feeds.event_feed_schema(), files_per_batch), load, checkpoint, once)


def stream_ingest_gkg(
    spark: SparkSession,
    in_dir: str,
    table: str,
    checkpoint: str,
    as_of: Callable[[], dt.date] | None = None,
    once: bool = True,
    files_per_batch: int | None = FILES_PER_BATCH,
):
    """Emotion feed directory to the emotions table; with `as_of` old days are dropped."""

    def load(batch: DataFrame, batch_id: int) -> None:
        parsed = parse_gkg(feeds.type_gkg_columns(batch))
        tables.append_new_gkg(parsed, table, as_of() if as_of else None)

    return _start(_feed_stream(spark, in_dir, feeds.gkg_feed_schema(), files_per_batch), load, checkpoint, once)


def stream_retention(as_of: Callable[[], dt.date], path: str, days: int = 30) -> Reporter:
    """A `foreachBatch` step that drops days past retention."""

    def drop(batch: DataFrame, batch_id: int) -> None:
        tables.drop_old_days(batch.sparkSession, path, as_of(), days)

    return drop


def stream_freshness(spark: SparkSession, table: str, as_of: dt.datetime) -> DataFrame:
    """Freshness of a stored events table against `as_of`."""
    newest = F.try_to_timestamp(F.col("DATE"), F.lit("yyyyMMdd"))
    return quality.freshness(tables.read_events(spark, table), newest, as_of)
