"""Marts that follow their tables day by day.

Day rows (the event cube, daily facts, daily emotions, mentions per theme and day) are stored
by day. A refresh reads the days that changed since the last one from the tables' ledgers, computes the
day rows of these days only, and derives what spans days (actors, countries, themes) from stored
day rows, never from raw rows. Ledger notes are settled last: a refresh that stopped anywhere is made good by
the next one, which works on the same days again. One refresh runs at a time; loads may run beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from presswire import schemas
from presswire.operators import marts
from presswire.operators.staging import stg_emotions, stg_events
from presswire.session import filesystem
from presswire.sources import tables
from presswire.sources.day_ledger import DayLedger, Pending

EVENT_DAY, EMOTION_DAY = "event_date_raw", "date_key"
#: Folder names of partitions whose day is null.
_NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
_BUILT = "_built"


class MartStore:
    """Marts of an event table and an emotion table, in folders below `root`."""

    def __init__(self, spark: SparkSession, root: str, events_path: str, gkg_path: str) -> None:
        self.spark, self.root = spark, root
        self.events_path, self.gkg_path = events_path, gkg_path

    # -- stored rows --------------------------------------------------------

    def _stored(self, name: str, like: DataFrame) -> DataFrame:
        """A stored table with the columns of `like`, in their order."""
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{name}").select(*like.columns)

    def _events(self) -> DataFrame:
        if not tables.table_exists(self.spark, self.events_path):
            return self.spark.createDataFrame([], schemas.EVENTS_RAW)
        return tables.read_events(self.spark, self.events_path)

    def _gkg(self) -> DataFrame:
        if not tables.table_exists(self.spark, self.gkg_path):
            return tables.with_gkg_day(self.spark.createDataFrame([], schemas.GKG_RAW))
        return tables.read_gkg(self.spark, self.gkg_path)

    def cube(self) -> DataFrame:
        return self._stored("event_cube", marts.event_cube(stg_events(self._events())))

    def theme_days(self) -> DataFrame:
        return self._stored("theme_days", marts.theme_days(stg_emotions(self._gkg())))

    def mart(self, name: str) -> DataFrame:
        """Rows of a mart as last refreshed."""
        if name in ("fct_daily_emotions", "fct_trending_themes"):
            staged = stg_emotions(self._gkg())
            like = marts.fct_daily_emotions(staged) if name == "fct_daily_emotions" else marts.fct_trending_themes(staged)
        else:
            staged = stg_events(self._events())
            like = {"fct_daily_events": marts.fct_daily_events, "dim_actors": _actor_columns,
                    "dim_countries": marts.dim_countries}[name](staged)
        return self._stored(name, like)

    # -- refreshing ---------------------------------------------------------

    def _replace_days(self, name: str, rows: DataFrame, partition: str, gone: list[str | None] | None) -> None:
        """Overwrite the days of `rows` and drop those of `gone`; None overwrites the whole table."""
        writer = rows.hint("rebalance", partition).write.mode("overwrite").partitionBy(partition)
        mode = "static" if gone is None else "dynamic"
        writer.option("partitionOverwriteMode", mode).parquet(f"{self.root}/{name}")
        for day in gone or ():
            folder = f"{self.root}/{name}/{partition}={_NULL_PARTITION if day is None else day}"
            place, fs = filesystem(self.spark, folder)
            fs.delete(place, True)

    def _mark(self, part: str) -> str:
        return f"{self.root}/{_BUILT}-{part}"

    def _due(self, part: str, path: str) -> tuple[DayLedger, Pending, bool]:
        """The ledger, what is pending, and whether all days must be built (no complete build yet)."""
        ledger, place = DayLedger(self.spark, path), filesystem(self.spark, self._mark(part))
        whole = not (ledger.kept() and place[1].exists(place[0]))
        if whole:
            ledger.start()  # before rows are read: a load from now on is noted
        return ledger, ledger.pending(), whole

    def _done(self, part: str, ledger: DayLedger, pending: Pending) -> None:
        place, fs = filesystem(self.spark, self._mark(part))
        fs.create(place, True).close()
        ledger.settle(pending)

    def refresh_events(self) -> list[str | None] | None:
        """Bring the event marts up to date; returns the days worked on, None for all of them."""
        ledger, pending, whole = self._due("events", self.events_path)
        if not (whole or pending.days):
            ledger.settle(pending)
            return []
        events, gone = self._events(), None
        if not whole:
            events = tables.on_days(events, tables.EVENT_PARTITION, pending.days)
            gone = _without_rows(events, tables.EVENT_PARTITION, pending.days)
        self._replace_days("event_cube", marts.event_cube(stg_events(events)), EVENT_DAY, gone)
        cube = self.cube()
        touched = cube if whole else tables.on_days(cube, EVENT_DAY, pending.days)
        self._replace_days("fct_daily_events", marts.fct_daily_events(touched), EVENT_DAY, gone)
        # both dimensions come from cells that are stored once
        marts.actor_cells(cube).write.mode("overwrite").parquet(f"{self.root}/actor_cells")
        cells = self._stored("actor_cells", marts.actor_cells(cube))
        marts.dim_actors(cells).write.mode("overwrite").parquet(f"{self.root}/dim_actors")
        countries = marts.dim_countries(marts.with_country_days(cells, cube))
        countries.write.mode("overwrite").parquet(f"{self.root}/dim_countries")
        self._done("events", ledger, pending)
        return None if whole else pending.days

    def refresh_emotions(self) -> list[str | None] | None:
        """Bring the emotion marts up to date; returns the days worked on, None for all of them."""
        ledger, pending, whole = self._due("emotions", self.gkg_path)
        if not (whole or pending.days):
            ledger.settle(pending)
            return []
        rows, gone = self._gkg(), None
        if not whole:
            rows = tables.on_days(rows, tables.GKG_PARTITION, pending.days)
            gone = _without_rows(rows, tables.GKG_PARTITION, pending.days)
        staged = stg_emotions(rows)
        self._replace_days("fct_daily_emotions", marts.fct_daily_emotions(staged), EMOTION_DAY, gone)
        themes = marts.theme_days(staged)
        # a day may keep rows and lose its last theme
        bare = None if whole else _without_rows(themes, EMOTION_DAY, pending.days)
        self._replace_days("theme_days", themes, EMOTION_DAY, bare)
        marts.fct_trending_themes(self.theme_days(), n=None).write.mode("overwrite").parquet(
            f"{self.root}/fct_trending_themes")
        self._done("emotions", ledger, pending)
        return None if whole else pending.days

    def refresh(self) -> None:
        self.refresh_events()
        self.refresh_emotions()


def _actor_columns(staged: DataFrame) -> DataFrame:
    """The columns of `dim_actors`, without the sorts that its ranks run."""
    rank = F.lit(0).cast("bigint")
    return marts.actor_stats(staged).withColumns({"event_rank": rank, "article_rank": rank})


def _without_rows(rows: DataFrame, partition: str, days: list[str | None]) -> list[str | None]:
    """Those of `days` that have no rows any more; reads the partition column alone."""
    left = set(tables.days_of(rows, partition))
    return [d for d in days if d not in left]
