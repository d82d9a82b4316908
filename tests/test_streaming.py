"""Streams give the same tables as batches, and a restart adds nothing."""

import datetime as dt
from collections import Counter

from presswire.operators.ingest import extract_headlines
from presswire.plans import registry as R
from presswire.session import work_path
from presswire.sources import feeds, tables
from presswire.streaming import counts, ingest as stream


def test_stream_of_many_batches_equals_one_batch(spark, sf_dir):
    feed = R.written_event_feed(spark, sf_dir)
    table, checkpoint, reports = work_path(spark, "s"), work_path(spark, "c"), []
    run = lambda: stream.stream_ingest_events(
        spark, feed, table, checkpoint, files_per_batch=2,
        report=lambda report, batch_id: reports.append((batch_id, report.count()))).awaitTermination()
    run()
    streamed = tables.read_events(spark, table)
    batch = extract_headlines(feeds.read_event_feed(spark, feed))
    ids = lambda df: sorted(r[0] for r in df.select("EVENT_ID").collect())
    assert ids(streamed) == ids(batch)
    assert len(reports) > 1 and all(n == 8 for _, n in reports)
    run()
    assert tables.read_events(spark, table).count() == batch.count()


def test_replay_without_checkpoint_adds_nothing(spark, sf_dir):
    feed, table = R.written_gkg_feed(spark, sf_dir), work_path(spark, "s")
    for _ in range(2):
        stream.stream_ingest_gkg(spark, feed, table, work_path(spark, "c")).awaitTermination()
    assert tables.read_gkg(spark, table).count() == R.gkg(spark, sf_dir).count()


def landed(spark, rows, schema, files):
    path = work_path(spark, "landed")
    for i in range(files):
        spark.createDataFrame(rows[i::files], schema).coalesce(1).write.mode("append").parquet(path)
    return path


def test_late_rows_of_unseen_keys_are_kept_and_repeats_dropped(spark):
    rows = [(str(i % 300), f"202401{1 + (i * 7) % 300 % 28:02d}") for i in range(900)]
    rows = [(k, f"202401{1 + int(k) % 28:02d}") for k, _ in rows] + [("x", None), ("x", None), (None, "20240105")]
    path = landed(spark, rows, "EVENT_ID string, DATE string", 5)
    out, checkpoint = work_path(spark, "out"), work_path(spark, "c")

    def run():
        stream_rows = spark.readStream.schema("EVENT_ID string, DATE string").option("maxFilesPerTrigger", 1).parquet(path)
        counts.stream_dedupe(stream_rows, "EVENT_ID", "DATE", out, checkpoint).awaitTermination()
        return sorted(map(tuple, spark.read.schema("EVENT_ID string, DATE string").parquet(out).collect()), key=repr)

    assert run() == sorted(set(rows), key=repr)
    assert run() == sorted(set(rows), key=repr)  # a restart adds nothing
    tables.append_new(spark.createDataFrame(rows, "EVENT_ID string, DATE string"), out, "EVENT_ID", "DATE")
    assert spark.read.parquet(out).count() == len(set(rows))  # nor does a replay


def test_daily_counts_of_mixed_days(spark):
    days = [dt.datetime(2024, 1, 1 + (i * 11) % 30, i % 24) for i in range(600)]
    path = landed(spark, [(d,) for d in days], "ts timestamp", 4)
    out, checkpoint = work_path(spark, "out"), work_path(spark, "c")
    for _ in range(2):
        rows = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
        counts.stream_daily_counts(rows, "ts", out, checkpoint).awaitTermination()
        got = {r.day: r.events for r in counts.latest_daily_counts(spark, out).collect()}
        assert got == Counter(d.strftime("%Y%m%d") for d in days)


def test_vectors_are_evaluated_once(spark, sf_dir):
    path, calls = work_path(spark, "events"), spark.sparkContext.accumulator(0)
    tables.append_new_events(R.vector_events(spark, sf_dir), path)
    fresh = R.new_vectors(spark, sf_dir)
    size = fresh.count()

    def counted(frames):
        for frame in frames:
            calls.add(len(frame))
            yield frame

    tables.write_embeddings(spark, path, fresh.mapInPandas(counted, fresh.schema))
    assert calls.value == size
    assert tables.read_events(spark, path).filter("EMBEDDING IS NULL").count() == 0
