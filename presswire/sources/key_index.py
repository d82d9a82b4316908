"""The keys a day-partitioned table holds, as a narrow table of its own.

An append must know whether a key is stored on any day, without reading days of wide rows. The index
has one row (key, day) per stored key in `_keys` below the table, one folder per load; folders are
joined into one, sorted by key, when they become many. A batch leaves its stored keys out by an
anti join that reads nothing but the key column of the index.

A load writes its keys beside the index, out of sight of look-ups, reads them from there, leaves a mark, writes its
rows, moves its keys into the index and takes the mark away. A mark that is still there tells the next load that rows may be stored whose keys are not: the index is
then built anew from the table's key column, as it is for a table without an index.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from presswire.session import filesystem

FOLDER = "_keys"
#: Keys of loads whose rows are not yet written; Spark's listings of the index leave the folder out.
STAGED = "_staged"
SCHEMA = "key string, day string, load string"
#: Folders that are joined into one.
MOST_LOADS = 48


def plain_key(key: Column) -> Column:
    """A key as text that is never null: a null is a key, and rows dealt by this column can be joined and grouped by it."""
    return F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit(""))


def stored_key(name: str) -> Column:
    """The key as text of a `plain_key` column."""
    return F.when(F.col(name) != "", F.substring(F.col(name), F.lit(2), F.length(name)))


class KeyIndex:
    """Index of the table at `path`; there is one writer at a time, as for the table."""

    def __init__(self, spark: SparkSession, path: str, key: str, partition: str) -> None:
        self.spark, self.path, self.key, self.partition = spark, path, key, partition
        self.folder = f"{path}/{FOLDER}"

    def _names(self, prefix: str) -> list[str]:
        place, fs = filesystem(self.spark, self.folder)
        found = [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []
        return [n for n in found if n.startswith(prefix)]

    def _delete(self, name: str) -> None:
        place, fs = filesystem(self.spark, f"{self.folder}/{name}")
        fs.delete(place, True)

    def stored(self) -> DataFrame:
        """(key, day) of every stored key."""
        return self.spark.read.schema(SCHEMA).parquet(self.folder).select("key", "day")

    def _write(self, keys: DataFrame) -> str:
        name = f"load={uuid.uuid4().hex}"
        keys.select(F.col("key").cast("string"), F.col("day").cast("string")).sortWithinPartitions("key").write.parquet(
            f"{self.folder}/{name}")
        return name

    def _replace(self, keys: DataFrame) -> None:
        """One folder of `keys` in place of all; a stop in between leaves keys twice, which changes no answer."""
        old = self._names("load=")
        self._write(keys.repartitionByRange("key"))
        for name in old:
            self._delete(name)

    def keys_of(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.col(self.key).alias("key"), F.col(self.partition).alias("day"))

    def ready(self, table: DataFrame) -> None:
        """Build the index from the table's keys if it is missing or a load has not ended."""
        self._delete(STAGED)  # of a load that stopped; there is one writer
        marks = self._names("open-")
        if marks or not self._names("load="):
            self._replace(self.keys_of(table))
            for name in marks:
                self._delete(name)
        elif len(self._names("load=")) > MOST_LOADS:
            self._replace(self.stored().distinct())

    def found(self, keys: DataFrame) -> DataFrame:
        """Those of the distinct `keys` (one column, `_known`) that are stored on any day; a null is a key."""
        stored = self.stored().select("key")
        return keys.join(stored, F.col("_known").cast("string").eqNullSafe(F.col("key")), "left_semi")

    def unseen(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows whose key in the column `name` (see `plain_key`) is stored on no day."""
        return rows.join(self.stored().select(plain_key(F.col("key")).alias(name)), name, "left_anti")

    def open(self) -> str:
        name = f"open-{uuid.uuid4().hex}"
        place, fs = filesystem(self.spark, f"{self.folder}/{name}")
        fs.create(place).close()
        return name

    def stage(self, keys: DataFrame) -> str:
        """Write the keys of a load (`_key`, see `plain_key`, `day`, `_rows`) once, for its own use and for the index."""
        name = uuid.uuid4().hex
        keys.select(stored_key("_key").alias("key"), F.col("day").cast("string"), "_rows").write.parquet(
            f"{self.folder}/{STAGED}/{name}")
        return name

    def staged(self, name: str) -> DataFrame:
        """The keys of `stage`, with their columns."""
        rows = self.spark.read.schema("key string, day string, _rows bigint").parquet(f"{self.folder}/{STAGED}/{name}")
        return rows.select(plain_key(F.col("key")).alias("_key"), "day", "_rows")

    def close(self, mark: str, name: str, empty: bool) -> None:
        """Take the staged keys of a load whose rows are written into the index."""
        if not empty or not self._names("load="):
            old, fs = filesystem(self.spark, f"{self.folder}/{STAGED}/{name}")
            new, _ = filesystem(self.spark, f"{self.folder}/load={name}")
            if not fs.rename(old, new):
                raise OSError(f"keys were not moved to {new}")
        self._delete(STAGED)
        self._delete(mark)

    def forget(self, gone: Column) -> None:
        """Drop keys whose days were deleted; `gone` is a condition on `day`."""
        if self._names("load="):
            self._replace(self.stored().filter(~F.coalesce(gone, F.lit(False))))
