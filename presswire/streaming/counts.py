"""Streaming dedupe and running daily counts, exact over any number of micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from presswire.session import materialize
from presswire.sources import tables

COUNTS = "events bigint, last_batch bigint, day string"


def stream_dedupe(stream: DataFrame, key: str, day_col: str, path: str, checkpoint: str):
    """Keep the first row of each key in a table partitioned by day.

    Every batch is reduced by key and anti-joined with the stored rows of its days, so a late
    row of an unseen key is kept, whenever it comes, and a replayed batch adds nothing.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        tables.append_new(batch, path, key, day_col)

    return (
        stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_daily_counts(stream: DataFrame, time_col: str, path: str, checkpoint: str):
    """Running number of events per day in a table with one partition per day.

    A batch adds its counts to the days that it touches and rewrites those only. Each day
    remembers the last batch it has seen, so a replayed batch counts once.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.groupBy(F.date_format(time_col, "yyyyMMdd").alias("day")).agg(F.count(F.lit(1)).alias("more"))
        if tables.table_exists(spark, path):
            known = spark.read.schema(COUNTS).parquet(path)
        else:
            known = spark.createDataFrame([], COUNTS)
        known = known.withColumnRenamed("day", "_day")
        added = fresh.join(known, fresh.day.eqNullSafe(known._day), "left").select(
            F.when(F.col("last_batch") >= batch_id, F.col("events"))
            .otherwise(F.coalesce("events", F.lit(0)) + F.col("more")).alias("events"),
            F.greatest(F.coalesce("last_batch", F.lit(-1)), F.lit(batch_id)).cast("bigint").alias("last_batch"),
            "day",
        )
        # a few rows, read from the partitions that the write replaces
        (
            materialize(added).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("day").parquet(path)
        )

    return (
        stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def latest_daily_counts(spark: SparkSession, path: str) -> DataFrame:
    """Count of each day."""
    return spark.read.schema(COUNTS).parquet(path).select("day", "events")
