"""Day-partitioned Parquet tables: append once, keep recent days, update vectors."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from presswire import schemas
from presswire.functions import dates
from presswire.operators.cleaning import keep_first
from presswire.session import filesystem, work_path
from presswire.sources.day_ledger import DayLedger
from presswire.sources.key_index import KeyIndex, plain_key

EVENT_PARTITION = "DATE"
GKG_PARTITION = "DATE_KEY"


def table_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = filesystem(spark, path)
    return fs.exists(hadoop_path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Stored events; a column missing from older files reads as NULL."""
    return spark.read.schema(schemas.EVENTS_RAW).parquet(path).select(*schemas.EVENTS_RAW.names)


def read_gkg(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType(schemas.GKG_RAW.fields + [T.StructField(GKG_PARTITION, T.StringType())])
    return spark.read.schema(schema).parquet(path)


def with_gkg_day(gkg: DataFrame) -> DataFrame:
    return gkg.withColumn(GKG_PARTITION, dates.gkg_day(F.col("DATE")))


def days_of(rows: DataFrame, partition: str) -> list[str | None]:
    """The distinct days of a batch: as many as the calendar has, whatever the number of rows."""
    return [r[0] for r in rows.select(partition).distinct().collect()]


def on_days(stored: DataFrame, partition: str, days: list[str | None]) -> DataFrame:
    """Stored rows of some days; the literals prune partitions, that of NULL days included."""
    column = F.col(partition)
    wanted = column.isin([d for d in days if d is not None])
    return stored.filter(wanted | column.isNull() if None in days else wanted)


def new_rows_only(
    batch: DataFrame, stored: DataFrame, key: str, date_col: str, partition_col: str | None = None
) -> DataFrame:
    """Batch rows whose key is not stored on any day from the batch's earliest one on.

    The earliest day is a literal, so older partitions are not read; a NULL day is read if the batch
    has one. A NULL key is a key like any other. An append looks in the key index of its table
    instead, which knows every day.
    """
    day = F.col(partition_col or date_col)
    first, none = batch.agg(F.min(day), F.count_if(day.isNull())).first()
    seen = day >= F.lit(first) if first is not None else F.lit(False)
    known = stored.filter(seen | day.isNull() if none else seen).select(F.col(key).alias("_known")).distinct()
    return batch.join(known, F.col(key).eqNullSafe(F.col("_known")), "left_anti").select(*batch.columns)


def one_row_per_key(batch: DataFrame, key: str, partition: str, index: KeyIndex | None = None) -> DataFrame:
    """The newest day's row of each key; equal days are resolved by a hash of the row.

    With an index, keys that it holds are left out. Rows are dealt by key once, for the look-up and the choice
    of a row; nothing is sorted before they are dealt, so a task's memory is that of one part.
    """
    keyed = batch.withColumn("_key", plain_key(F.col(key))).repartition("_key")
    fresh = keyed if index is None else index.unseen(keyed, "_key")
    order = [F.col(partition).desc_nulls_last(), F.xxhash64(*batch.columns)]
    return keep_first(fresh, [F.col("_key")], order).select(*batch.columns)


def unseen_keys(batch: DataFrame, key: str, partition: str, index: KeyIndex | None = None) -> DataFrame:
    """Each key of a batch that the index does not hold: `_key` (see `plain_key`), its newest `day` and its `_rows`."""
    keyed = batch.select(plain_key(F.col(key)).alias("_key"), F.col(partition).alias("day")).repartition("_key")
    unseen = keyed if index is None else index.unseen(keyed, "_key")
    return unseen.groupBy("_key").agg(F.max("day").cast("string").alias("day"), F.count(F.lit(1)).alias("_rows"))


def rows_of_keys(batch: DataFrame, key: str, partition: str, keys: DataFrame, repeated: bool) -> DataFrame:
    """One row of the batch per key of `keys` (see `unseen_keys`); `repeated` tells whether any has several.

    Keys are looked up by a condition: Spark takes it down to where a row has its key, before other tables are
    joined and wide columns are built, as it does not with a join on a computed column. Only the rows of repeated
    keys are dealt and sorted to choose one.
    """
    keyed = batch.withColumn("_key", plain_key(F.col(key)))

    def of(some: DataFrame) -> DataFrame:
        asked = "SELECT * FROM {keyed} WHERE _key IN (SELECT _key FROM {some})"
        return batch.sparkSession.sql(asked, keyed=keyed, some=some.select("_key")).select(*batch.columns)

    rows = of(keys.filter("_rows = 1"))
    return rows.unionByName(one_row_per_key(of(keys.filter("_rows > 1")), key, partition)) if repeated else rows


def append_new(
    batch: DataFrame, path: str, key: str, date_col: str, partition_col: str | None = None
) -> DataFrame:
    """Append unseen rows to the table at `path`, creating it on the first load.

    A key is stored once, whatever its day and whatever batch it comes in: keys are looked up in the
    table's key index, so no stored day is read, and a key repeated in the batch keeps one row. Running
    the same batch twice adds nothing, also after a load that stopped half-way. The batch is read twice,
    first its keys and days alone, then the rows to be stored: it must give the same rows both times, so a
    caller holds one that is costly or may differ. Rows are
    grouped by day before the write to keep the number of files low; a large day is split over
    several tasks by the rebalance. Returns the stored table.
    """
    spark, schema = batch.sparkSession, batch.schema
    partition = partition_col or date_col
    index, ledger = KeyIndex(spark, path, key, partition), DayLedger(spark, path)
    stored = table_exists(spark, path)
    if stored:
        index.ready(spark.read.schema(schema).parquet(path))
    # written, not held: a stored part is as large as its rows, and a write to the table would make held keys anew
    name = index.stage(unseen_keys(batch, key, partition, index if stored else None))
    keys = index.staged(name)
    days = keys.groupBy("day").agg(F.max("_rows").alias("most")).collect()  # as many as the calendar has
    mark = index.open()
    note = ledger.note(spark.createDataFrame([(r.day,) for r in days], "day string"), "day")
    if days or not stored:
        fresh = rows_of_keys(batch, key, partition, keys, any(r.most > 1 for r in days))
        fresh.hint("rebalance", partition).write.mode("append").partitionBy(partition).parquet(path)
    index.close(mark, name, empty=not days)
    ledger.end(note)
    return spark.read.schema(schema).parquet(path)


def append_new_events(batch: DataFrame, path: str) -> DataFrame:
    """Append events by EVENT_ID; a batch without vectors gets a NULL EMBEDDING."""
    spark = batch.sparkSession
    empty = spark.createDataFrame([], schemas.EVENTS_RAW).limit(0)  # known as empty, the union goes from the plan
    full = empty.unionByName(batch, allowMissingColumns=True)
    append_new(full, path, "EVENT_ID", EVENT_PARTITION)
    return read_events(spark, path)


def retain(gkg: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """Emotion rows not older than midnight `days` days before `as_of`."""
    return gkg.filter(F.col("DATE") >= F.lit(dates.gkg_day_cutoff(as_of, days)))


def drop_old_days(spark: SparkSession, path: str, as_of: dt.date, days: int = 30) -> int:
    """Delete the day partitions before the retention cutoff; returns how many."""
    cutoff = dates.days_before(as_of, days)
    hadoop_path, fs = filesystem(spark, path)
    old = {}
    for status in fs.listStatus(hadoop_path):
        name, _, day = status.getPath().getName().partition("=")
        if name == GKG_PARTITION and day < cutoff:
            old[day] = status.getPath()
    if old:
        ledger = DayLedger(spark, path)
        note = ledger.note(spark.createDataFrame([(day,) for day in old], "day string"), "day")
        for folder in old.values():
            fs.delete(folder, True)
        KeyIndex(spark, path, "GKG_ID", GKG_PARTITION).forget(F.col("day") < cutoff)
        ledger.end(note)
    return len(old)


def append_new_gkg(batch: DataFrame, path: str, as_of: dt.date | None = None) -> DataFrame:
    """Append emotion rows by GKG_ID, then drop days past retention when `as_of` is given."""
    stored = append_new(with_gkg_day(batch), path, "GKG_ID", "DATE", GKG_PARTITION)
    if as_of is not None:
        drop_old_days(batch.sparkSession, path, as_of)
        stored = stored.sparkSession.read.schema(stored.schema).parquet(path)
    return stored


def merge_embeddings(events: DataFrame, vectors: DataFrame) -> DataFrame:
    """Events with EMBEDDING replaced where `vectors(EVENT_ID, EMBEDDING)` has a value.

    An id given twice takes the larger vector, so it never multiplies event rows.
    """
    new = vectors.filter(F.col("EMBEDDING").isNotNull()).groupBy("EVENT_ID").agg(
        F.max("EMBEDDING").alias("_new")
    )
    return (
        events.join(new, "EVENT_ID", "left")
        .withColumn("EMBEDDING", F.coalesce("_new", "EMBEDDING"))
        .select(*events.columns)
    )


def write_embeddings(spark: SparkSession, path: str, vectors: DataFrame) -> DataFrame:
    """Store new vectors, rewriting only the days that hold an updated event.

    `vectors` (EVENT_ID, EMBEDDING and, to find the days without a scan, DATE) is evaluated
    once: it is written to the shared folder first and read from there. The rewritten days
    are staged before they replace the stored ones, and both copies are removed at the end.
    """
    fresh, staged = work_path(spark, "vectors"), work_path(spark, "embeddings")
    vectors.write.parquet(fresh)
    vectors = spark.read.schema(vectors.schema).parquet(fresh)
    events = read_events(spark, path)
    if "DATE" in vectors.columns:
        days = days_of(vectors, EVENT_PARTITION)
    else:
        days = days_of(events.join(vectors.select("EVENT_ID"), "EVENT_ID", "left_semi"), EVENT_PARTITION)
    merge_embeddings(on_days(events, EVENT_PARTITION, days), vectors).write.parquet(staged)
    ledger = DayLedger(spark, path)
    note = ledger.note(spark.createDataFrame([(day,) for day in days], "day string"), "day")
    (
        spark.read.schema(schemas.EVENTS_RAW).parquet(staged)
        .hint("rebalance", EVENT_PARTITION)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(EVENT_PARTITION).parquet(path)
    )
    ledger.end(note)
    for done in (fresh, staged):
        hadoop_path, fs = filesystem(spark, done)
        fs.delete(hadoop_path, True)
    return read_events(spark, path)


def load_stats(events: DataFrame, inserted: DataFrame | None = None) -> DataFrame:
    """Total rows, rows with a vector and, when given, the rows of the last load."""
    stats = events.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count("EMBEDDING").alias("embedded_rows")
    )
    if inserted is not None:
        stats = stats.withColumn("inserted_rows", inserted.agg(F.count(F.lit(1))).scalar())
    return stats
