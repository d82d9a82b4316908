"""Parameterised event look-ups.

Every look-up takes a date predicate (see `period`) and considers events with a known actor
and country.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from presswire import schemas
from presswire.functions import headlines, labels, text as T
from presswire.functions.dates import (
    between_days, calendar_month, calendar_week, day_key, days_before,
)
from presswire.operators.cleaning import dedupe_headlines, with_accepted
from presswire.operators.countries import country_name

DEFAULT_ROWS = 5
EVENT_COLUMNS = [
    "EVENT_ID", "DATE", "ACTOR_COUNTRY_CODE", "HEADLINE", "MAIN_ACTOR", "IMPACT_SCORE",
    "ARTICLE_COUNT", "NEWS_LINK",
]
_ROLLING_DAYS = {"week": 7, "month": 30, "quarter": 90}


def period(as_of: dt.date, name: str = "week", month: int | None = None, day: dt.date | None = None) -> Column:
    """Date predicate: `day`, `week`, `month`, `quarter` (90 days), `all`, `last_week`, `this_week`,
    `calendar_month` (with `month`) or `specific` (with `day`)."""
    if name == "specific":
        return F.col("DATE") == day_key(day)
    if name == "all":
        return F.lit(True)
    if name == "day":
        return F.col("DATE") == day_key(as_of)
    if name in ("last_week", "this_week"):
        return between_days(*calendar_week(as_of, "previous" if name == "last_week" else "current"))
    if name == "calendar_month":
        return between_days(*calendar_month(as_of, month))
    return F.col("DATE") >= days_before(as_of, _ROLLING_DAYS[name])


def _known(events: DataFrame, when: Column, countries: Sequence[str] | None = None) -> DataFrame:
    found = events.filter(F.col("MAIN_ACTOR").isNotNull() & F.col("ACTOR_COUNTRY_CODE").isNotNull() & when)
    return found.filter(F.col("ACTOR_COUNTRY_CODE").isin(list(countries))) if countries else found


def country_ranking(events: DataFrame, when: Column, crisis: bool = False, n: int = DEFAULT_ROWS) -> DataFrame:
    """Countries by number of events, or of events with impact below -3."""
    found = _known(events, when)
    if crisis:
        found = found.filter(F.col("IMPACT_SCORE") < -3)
    return (
        found.groupBy("ACTOR_COUNTRY_CODE").agg(F.count(F.lit(1)).alias("EVENT_COUNT"))
        .orderBy(F.col("EVENT_COUNT").desc(), F.col("ACTOR_COUNTRY_CODE"))
        .limit(n)
    )


def lookup_crisis_by_country(events: DataFrame, when: Column, n: int = DEFAULT_ROWS) -> DataFrame:
    return country_ranking(events, when, crisis=True, n=n)


def lookup_top_countries(events: DataFrame, when: Column, n: int = DEFAULT_ROWS) -> DataFrame:
    return country_ranking(events, when, n=n)


def lookup_event_count(events: DataFrame, when: Column, countries: Sequence[str] | None = None) -> DataFrame:
    """Number of events, of the given countries if there are any."""
    return _known(events, when, countries).agg(F.count(F.lit(1)).alias("TOTAL_EVENTS"))


event_count_by_filter = lookup_event_count


def _by(events: DataFrame, order: list[Column], n: int | None) -> DataFrame:
    """The first `n` events; all of them, in no order, without `n`."""
    chosen = events.select(*EVENT_COLUMNS)
    return chosen if n is None else chosen.orderBy(*order, F.col("EVENT_ID")).limit(n)


def lookup_crisis_events(
    events: DataFrame, when: Column, countries: Sequence[str] | None = None, n: int | None = 250
) -> DataFrame:
    found = _known(events, when, countries).filter(
        (F.col("ARTICLE_COUNT") >= 3) & (F.col("IMPACT_SCORE") < -3)
    )
    return _by(found, [F.col("ARTICLE_COUNT").desc(), F.col("IMPACT_SCORE")], n)


def lookup_major_events(events: DataFrame, when: Column, n: int | None = 250) -> DataFrame:
    return _by(_known(events, when).filter(F.col("ARTICLE_COUNT") > 20), [F.col("ARTICLE_COUNT").desc()], n)


def lookup_events(
    events: DataFrame, when: Column, countries: Sequence[str] | None = None, n: int | None = 250
) -> DataFrame:
    """Events with more than three articles; the date orders ties only for given countries."""
    order = [F.col("ARTICLE_COUNT").desc(), *([F.col("DATE").desc()] if countries else [])]
    return _by(_known(events, when, countries).filter(F.col("ARTICLE_COUNT") > 3), order, n)


def present_events(
    found: DataFrame, iso: DataFrame, order: list[Column], n: int = DEFAULT_ROWS
) -> DataFrame:
    """Cleaned, deduplicated and labelled look-up rows.

    A long stored headline is cleaned as it is; only short ones give way to the link's.
    """
    long_enough = F.length(T.strip(F.col("HEADLINE"))) > 15
    chosen = F.when(long_enough, F.col("HEADLINE")).otherwise(headlines.headline_from_url(F.col("NEWS_LINK")))
    clean = with_accepted(found, "HEADLINE", headlines.clean_headline(chosen))
    distinct = dedupe_headlines(clean, [*order, F.col("EVENT_ID")])
    top = distinct.orderBy(*order, F.col("EVENT_ID")).limit(n)
    code = F.col("ACTOR_COUNTRY_CODE")
    return country_name(top, "ACTOR_COUNTRY_CODE", iso, "_country").select(
        "EVENT_ID",
        F.coalesce(F.date_format(schemas.event_day(F.col("DATE")), "MMM dd"), F.col("DATE")).alias("DATE"),
        "HEADLINE",
        F.coalesce(F.col("_country"), code, F.lit("—")).alias("COUNTRY"),
        labels.impact_label(F.col("IMPACT_SCORE")).alias("SEVERITY"),
        "IMPACT_SCORE",
        "NEWS_LINK",
    )
