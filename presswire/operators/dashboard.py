"""Dashboard aggregates over stored events; every window ends at an explicit `as_of`."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from presswire.functions import fixed_values as V
from presswire.functions import labels
from presswire.functions.dates import days_before, filter_recent

ALERT_DAYS, WEEK, MONTH, QUARTER = 3, 7, 30, 90
STORY_COLUMNS = [
    "EVENT_ID", "DATE", "NEWS_LINK", "HEADLINE", "MAIN_ACTOR", "ACTOR_COUNTRY_CODE",
    "IMPACT_SCORE", "ARTICLE_COUNT",
]


def _n() -> Column:
    return F.count(F.lit(1))


def weekly_metrics(events: DataFrame, as_of: dt.date) -> DataFrame:
    """Events of the week and how many of them have an absolute impact above 6."""
    return filter_recent(events, as_of, WEEK).agg(
        _n().alias("recent"), F.count_if(F.abs("IMPACT_SCORE") > 6).alias("critical")
    )


def _events_per_country(events: DataFrame) -> DataFrame:
    return (
        events.filter(F.col("ACTOR_COUNTRY_CODE").isNotNull())
        .groupBy("ACTOR_COUNTRY_CODE").agg(_n().alias("events"))
    )


def weekly_hotspot(events: DataFrame, as_of: dt.date) -> DataFrame:
    """Country with most events in the week."""
    return (
        _events_per_country(filter_recent(events, as_of, WEEK))
        .orderBy(F.col("events").desc(), F.col("ACTOR_COUNTRY_CODE"))
        .limit(1)
    )


def dashboard_metrics(events: DataFrame, as_of: dt.date) -> DataFrame:
    """Total, week, critical and hotspot in one row from one pass over the events.

    Events are first counted per country, so the hotspot is a maximum over few rows.
    """
    in_week = F.col("DATE") >= days_before(as_of, WEEK)
    per_country = events.groupBy("ACTOR_COUNTRY_CODE").agg(
        _n().alias("total"),
        F.count_if(in_week).alias("recent"),
        F.count_if(in_week & (F.abs("IMPACT_SCORE") > 6)).alias("critical"),
    )
    known = F.col("ACTOR_COUNTRY_CODE").isNotNull() & (F.col("recent") > 0)
    first = F.min(F.when(known, F.struct((-F.col("recent")).alias("n"), "ACTOR_COUNTRY_CODE")))
    return per_country.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("recent"), F.lit(0)).alias("recent"),
        F.coalesce(F.sum("critical"), F.lit(0)).alias("critical"),
        first["ACTOR_COUNTRY_CODE"].alias("hotspot"),
    )


def alerts(events: DataFrame, as_of: dt.date, n: int = 15) -> DataFrame:
    """Worst recent events with a known actor."""
    return (
        filter_recent(events, as_of, ALERT_DAYS)
        .filter((F.col("IMPACT_SCORE") < -4) & F.col("MAIN_ACTOR").isNotNull())
        .select("EVENT_ID", "MAIN_ACTOR", "ACTOR_COUNTRY_CODE", "IMPACT_SCORE")
        .orderBy(F.col("IMPACT_SCORE"), F.col("EVENT_ID"))
        .limit(n)
    )


def _stories(events: DataFrame, as_of: dt.date) -> DataFrame:
    return (
        filter_recent(events, as_of, WEEK)
        .filter(
            F.col("NEWS_LINK").isNotNull()
            & F.col("ACTOR_COUNTRY_CODE").isNotNull()
            & (F.length("HEADLINE") > 20)
        )
        .select(*STORY_COLUMNS)
    )


def _first(stories: DataFrame, order: list[Column], n: int | None) -> DataFrame:
    return stories if n is None else stories.orderBy(*order, F.col("EVENT_ID")).limit(n)


def trending_week(events: DataFrame, as_of: dt.date, n: int | None = 500) -> DataFrame:
    """Stories of the week by article count, then date; `n=None` returns all, in no order."""
    order = [F.col("ARTICLE_COUNT").desc(), F.col("DATE").desc()]
    return _first(_stories(events, as_of).filter(F.col("ARTICLE_COUNT") > 3), order, n)


def feed_week(events: DataFrame, as_of: dt.date, n: int | None = 500) -> DataFrame:
    """Stories of the week by date, then article count; `n=None` returns all, in no order."""
    return _first(_stories(events, as_of), [F.col("DATE").desc(), F.col("ARTICLE_COUNT").desc_nulls_last()], n)


def countries_month(events: DataFrame, as_of: dt.date) -> DataFrame:
    return (
        _events_per_country(filter_recent(events, as_of, MONTH))
        .withColumnRenamed("ACTOR_COUNTRY_CODE", "country")
        .orderBy(F.col("events").desc(), F.col("country"))
    )


def timeseries_month(events: DataFrame, as_of: dt.date) -> DataFrame:
    """Daily events, clearly negative and clearly positive ones."""
    return (
        filter_recent(events, as_of, MONTH)
        .groupBy("DATE")
        .agg(
            _n().alias("events"),
            F.count_if(F.col("IMPACT_SCORE") < -2).alias("negative"),
            F.count_if(F.col("IMPACT_SCORE") > 2).alias("positive"),
        )
        .orderBy("DATE")
    )


def sentiment_week(events: DataFrame, as_of: dt.date) -> DataFrame:
    """Mean impact of the week and how many events are beyond -3 and 3."""
    return (
        filter_recent(events, as_of, WEEK)
        .filter(F.col("IMPACT_SCORE").isNotNull())
        .agg(
            F.avg("IMPACT_SCORE").alias("avg"),
            F.count_if(F.col("IMPACT_SCORE") < -3).alias("neg"),
            F.count_if(F.col("IMPACT_SCORE") > 3).alias("pos"),
            _n().alias("total"),
        )
    )


def weekly_sentiment_status(events: DataFrame, as_of: dt.date) -> DataFrame:
    return sentiment_week(events, as_of).withColumn("status", labels.sentiment_status(F.col("avg")))


def actors_week(events: DataFrame, as_of: dt.date, n: int = 10) -> DataFrame:
    """Most active (actor, country) pairs of the week."""
    return (
        filter_recent(events, as_of, WEEK)
        .filter(F.length("MAIN_ACTOR") > 3)
        .groupBy("MAIN_ACTOR", "ACTOR_COUNTRY_CODE")
        .agg(_n().alias("events"), F.avg("IMPACT_SCORE").alias("avg_impact"))
        .orderBy(F.col("events").desc(), F.col("MAIN_ACTOR"), F.col("ACTOR_COUNTRY_CODE").asc_nulls_last())
        .limit(n)
    )


def tone_distribution(events: DataFrame, as_of: dt.date) -> DataFrame:
    """Five-way histogram of the known impacts of the week."""
    return (
        filter_recent(events, as_of, WEEK)
        .filter(F.col("IMPACT_SCORE").isNotNull())
        .groupBy(labels.banded(F.col("IMPACT_SCORE"), V.TONE_HISTOGRAM_BANDS).alias("cat"))
        .agg(_n().alias("cnt"))
    )
