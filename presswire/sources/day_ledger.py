"""Which days of a day-partitioned table changed since its marts were last derived.

The ledger lies in `_days` below the table and is kept only once `start` made it. A writer notes
the days it is about to change, changes them, and then marks the note as ended. A reader
takes all notes, works on their days and settles those that had ended when it looked: a
note of a load that still runs, or that stopped half-way, stays for the next reader, so no change is
missed and a day is at worst worked on twice. There is one writer at a time; its next note ends what an
interrupted one left open.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from presswire.session import filesystem

FOLDER = "_days"
SCHEMA = "day string"


@dataclass(frozen=True)
class Pending:
    """Days to work on, and the notes that may go once that is done."""

    days: list[str | None]
    settled: list[str]


class DayLedger:
    """Notes of the table at `path`; without `start` nothing is noted and writers pay nothing."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.folder = spark, f"{path}/{FOLDER}"

    def kept(self) -> bool:
        place, fs = filesystem(self.spark, self.folder)
        return fs.exists(place)

    def start(self) -> None:
        place, fs = filesystem(self.spark, self.folder)
        fs.mkdirs(place)

    def _names(self) -> tuple[list[str], set[str]]:
        """Notes, and those of them that ended; ends are listed first, so an end seen has its note."""
        place, fs = filesystem(self.spark, self.folder)
        names = [s.getPath().getName() for s in fs.listStatus(place)]
        ended = {n.removeprefix("ended-") for n in names if n.startswith("ended-")}
        return [n for n in names if n.startswith("note-")], ended

    def _delete(self, name: str) -> None:
        place, fs = filesystem(self.spark, f"{self.folder}/{name}")
        fs.delete(place, True)

    def note(self, days: DataFrame, day: Column | str) -> str | None:
        """Note the distinct days of a change before it is made; None if no ledger is kept."""
        if not self.kept():
            return None
        notes, ended = self._names()
        for left in set(notes) - ended:
            self.end(left)
        name = f"note-{uuid.uuid4().hex}"
        column = F.col(day) if isinstance(day, str) else day
        days.select(column.cast("string").alias("day")).distinct().coalesce(1).write.parquet(f"{self.folder}/{name}")
        return name

    def end(self, name: str | None) -> None:
        """The change of a note is complete."""
        if name is not None:
            place, fs = filesystem(self.spark, f"{self.folder}/ended-{name}")
            fs.create(place, True).close()

    def pending(self) -> Pending:
        """Days of all notes: as many as the calendar has, whatever the number of rows."""
        notes, ended = self._names()
        if not notes:
            return Pending([], [])
        noted = self.spark.read.schema(SCHEMA).parquet(*[f"{self.folder}/{n}" for n in notes])
        return Pending([r.day for r in noted.distinct().collect()], [n for n in notes if n in ended])

    def settle(self, pending: Pending) -> None:
        for name in pending.settled:
            self._delete(name)
            self._delete(f"ended-{name}")
