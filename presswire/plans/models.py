"""Model build: staging views and mart tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from presswire.operators import marts
from presswire.operators.staging import stg_emotions, stg_events
from presswire.session import work_path

MART_NAMES = [
    "fct_daily_events", "dim_actors", "dim_countries", "fct_daily_emotions", "fct_trending_themes",
]


def register_staging(events: DataFrame, gkg: DataFrame) -> None:
    stg_events(events).createOrReplaceTempView("stg_events")
    stg_emotions(gkg).createOrReplaceTempView("stg_gkg_emotions")


def mart_frames(events: DataFrame, emotions: DataFrame) -> dict[str, Callable[[], DataFrame]]:
    """Mart name -> builder over the event cube (or staged events) and staged emotions."""
    return {
        "fct_daily_events": lambda: marts.fct_daily_events(events),
        "dim_actors": lambda: marts.dim_actors(events),
        "dim_countries": lambda: marts.dim_countries(events),
        "fct_daily_emotions": lambda: marts.fct_daily_emotions(emotions),
        "fct_trending_themes": lambda: marts.fct_trending_themes(emotions, n=None),
    }


def build_models(events: DataFrame, gkg: DataFrame, root: str | None = None) -> list[str]:
    """Register staging views and overwrite the mart tables; returns the table names.

    The three event marts read one stored pre-aggregation, so the wide event table is
    scanned once. With `root` the tables are external ones below that path.
    """
    spark = events.sparkSession
    register_staging(events, gkg)
    path = work_path(spark, "event-cube")
    marts.event_cube(spark.table("stg_events")).write.parquet(path)
    cube = spark.read.parquet(path)
    for name, build in mart_frames(cube, spark.table("stg_gkg_emotions")).items():
        writer = build().write.mode("overwrite").format("parquet")
        if root is not None:
            writer = writer.option("path", f"{root}/{name}")
        writer.saveAsTable(name)
    return MART_NAMES
