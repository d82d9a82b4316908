"""Mart tables.

All event marts come from one pre-aggregation of the staged events by (day, country, actor),
which combines on the map side. Distinct counts and averages are worked out from its rows,
never from raw events; several marts can share a stored copy of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from presswire import schemas
from presswire.functions import fixed_values as V
from presswire.functions import packed
from presswire.functions.numeric import percentage, round_half_away
from presswire.operators.ranking import global_rank
from presswire.operators.staging import stg_emotion_days

_CATEGORY_COLUMNS = {
    "Very Negative": "very_negative_count",
    "Negative": "negative_count",
    "Neutral": "neutral_count",
    "Positive": "positive_count",
    "Very Positive": "very_positive_count",
}


CUBE_KEYS = ["event_date_raw", "actor_country_code", "actor_name"]
_AVERAGED = ["article_count", "goldstein_scale", "avg_tone"]


def event_cube(staged: DataFrame) -> DataFrame:
    """Counts, sums and flags per (day, country, actor)."""
    return staged.groupBy(*CUBE_KEYS).agg(
        F.count(F.lit(1)).alias("events"),
        *[F.sum(c).alias(f"sum_{c}") for c in _AVERAGED],
        *[F.count(c).alias(f"n_{c}") for c in _AVERAGED],
        F.max("article_count").alias("max_articles"),
        *[F.count_if(F.col("sentiment_category") == label).alias(name) for label, name in _CATEGORY_COLUMNS.items()],
        F.count_if("has_headline").alias("with_headline"),
        F.count_if("has_embedding").alias("with_embedding"),
        F.count_if(F.col("goldstein_scale") < 0).alias("below_zero"),
        F.count_if(F.col("goldstein_scale") >= 0).alias("from_zero"),
    )


def _cube_of(events: DataFrame) -> DataFrame:
    """`events` itself if it is a cube, else the cube of staged events."""
    return events if "sum_article_count" in events.columns else event_cube(events)


def _average(column: str) -> Column:
    return F.try_divide(F.sum(f"sum_{column}"), F.sum(f"n_{column}"))


def _reach_and_tone() -> list[Column]:
    return [
        F.sum("sum_article_count").alias("total_articles"),
        _average("article_count").alias("avg_articles_per_event"),
        _average("goldstein_scale").alias("avg_goldstein_scale"),
        _average("avg_tone").alias("avg_tone"),
    ]


def _day_text(day: Column) -> Column:
    """An eight-digit day key from its number."""
    return F.lpad(day.cast("string"), 8, "0")


def actor_cells(events: DataFrame) -> DataFrame:
    """Counts, sums and days per (actor, country), nulls included; actors and countries are worked out from them.

    The cube has one row per day of each pair, so days are a plain count. The bounds of the eight-digit day keys are
    compared as numbers so that the aggregation can hash instead of sort.
    """
    day = F.col("event_date_raw").try_cast("int")
    added = [f"{kind}_{c}" for c in _AVERAGED for kind in ("sum", "n")]
    return _cube_of(events).groupBy("actor_name", "actor_country_code").agg(
        F.sum("events").alias("events"),
        F.count("event_date_raw").alias("cell_days"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
        F.max("max_articles").alias("max_articles"),
        *[F.sum(c).alias(c) for c in (*added, *_CATEGORY_COLUMNS.values(), "below_zero", "from_zero")],
    )


def country_days(events: DataFrame) -> DataFrame:
    """Number of active days per country."""
    days = F.count_distinct("event_date_raw").alias("active_days")
    return _cube_of(events).groupBy("actor_country_code").agg(days)


def with_country_days(cells: DataFrame, events: DataFrame) -> DataFrame:
    """Actor cells with the active days of their country, from which `dim_countries` is worked out."""
    days = country_days(events).select(F.col("actor_country_code").alias("_country"), "active_days")
    return cells.join(days, F.col("actor_country_code") == F.col("_country"), "left").drop("_country")


def fct_daily_events(events: DataFrame, approx: bool = False) -> DataFrame:
    """Daily counts, reach, sentiment mix and coverage, newest day first; from staged events or their cube."""
    distinct = F.approx_count_distinct if approx else F.count_distinct
    daily = _cube_of(events).groupBy("event_date_raw").agg(
        F.sum("events").alias("event_count"),
        distinct(F.col("actor_name")).alias("unique_actors"),
        distinct(F.col("actor_country_code")).alias("unique_countries"),
        *_reach_and_tone(),
        *[F.sum(name).alias(name) for name in _CATEGORY_COLUMNS.values()],
        F.sum("with_headline").alias("events_with_headlines"),
        F.sum("with_embedding").alias("events_with_embeddings"),
    )
    day, total = F.col("event_date_raw"), F.col("event_count")
    return daily.select(
        day,
        F.substring(day, 1, 4).try_cast("int").alias("event_year"),
        F.substring(day, 5, 2).try_cast("int").alias("event_month"),
        F.substring(day, 7, 2).try_cast("int").alias("event_day"),
        *[c for c in daily.columns if c != "event_date_raw"],
        percentage(F.col("events_with_headlines"), total).alias("headline_coverage_pct"),
        percentage(F.col("events_with_embeddings"), total).alias("embedding_coverage_pct"),
        percentage(F.col("positive_count") + F.col("very_positive_count"), total).alias("positive_event_pct"),
        percentage(F.col("negative_count") + F.col("very_negative_count"), total).alias("negative_event_pct"),
    ).orderBy(F.col("event_date_raw").desc_nulls_last())


def _typical_sentiment() -> Column:
    """Most frequent of the five buckets; the alphabetically first one on a tie."""
    most = F.greatest(*_CATEGORY_COLUMNS.values())
    first, *others = sorted(_CATEGORY_COLUMNS)
    found = F.when(F.col(_CATEGORY_COLUMNS[first]) == most, first)
    for label in others:
        found = found.when(F.col(_CATEGORY_COLUMNS[label]) == most, label)
    return found


def actor_stats(events: DataFrame) -> DataFrame:
    """Per (actor, country) activity, reach and sentiment profile; from staged events, their cube or its actor cells."""
    cells = events if "cell_days" in events.columns else actor_cells(events)
    averages = {"article_count": "avg_articles_per_event", "goldstein_scale": "avg_goldstein_scale", "avg_tone": "avg_tone"}
    return cells.filter(F.col("actor_name").isNotNull()).select(
        "actor_name",
        "actor_country_code",
        F.col("events").alias("total_events"),
        F.col("cell_days").alias("active_days"),
        _day_text(F.col("first_day")).alias("first_seen_date"),
        _day_text(F.col("last_day")).alias("last_seen_date"),
        F.col("sum_article_count").alias("total_articles"),
        *[F.try_divide(F.col(f"sum_{c}"), F.col(f"n_{c}")).alias(name) for c, name in averages.items()],
        F.col("max_articles").alias("max_articles_single_event"),
        _typical_sentiment().alias("typical_sentiment"),
    )


def dim_actors(events: DataFrame) -> DataFrame:
    """Actor profiles with their rank by events and by articles."""
    tie = [F.col("actor_name").asc_nulls_last(), F.col("actor_country_code").asc_nulls_last()]
    stats = actor_stats(events)
    by_events = global_rank(stats, [F.col("total_events").desc_nulls_last(), *tie], "event_rank")
    return global_rank(by_events, [F.col("total_articles").desc_nulls_last(), *tie], "article_rank")


def dim_countries(events: DataFrame) -> DataFrame:
    """Country profiles with their rank by activity; from staged events, their cube or its actor cells `with_country_days`.

    Country codes are three letters, so the ranked table is small by its key domain. A cell is one actor of a country:
    from cells, distinct actors are a plain count.
    """
    if "cell_days" in events.columns:
        rows, first, last = events, F.col("first_day"), F.col("last_day")
        distinct = [F.count("actor_name").alias("unique_actors"), F.max("active_days").alias("active_days")]
    else:
        rows = _cube_of(events)
        first = last = F.col("event_date_raw").try_cast("int")
        distinct = [F.count_distinct("actor_name").alias("unique_actors"), F.count_distinct("event_date_raw").alias("active_days")]
    stats = (
        rows.filter(F.col("actor_country_code").isNotNull())
        .groupBy(F.col("actor_country_code").alias("country_code"))
        .agg(
            F.sum("events").alias("total_events"),
            *distinct,
            _day_text(F.min(first)).alias("first_event_date"),
            _day_text(F.max(last)).alias("last_event_date"),
            *_reach_and_tone(),
            F.sum("below_zero").alias("negative_events"),
            F.sum("from_zero").alias("positive_events"),
        )
    )
    order = Window.orderBy(F.col("total_events").desc_nulls_last(), F.col("country_code"))
    return stats.withColumn(
        "negative_event_pct", percentage(F.col("negative_events"), F.col("total_events"))
    ).withColumn("activity_rank", F.row_number().over(order).cast("bigint"))


def fct_daily_emotions(staged: DataFrame) -> DataFrame:
    """Daily mean mood and emotions, rounded to two places, newest day first."""
    measures = {
        "avg_mood": "avg_tone",
        "avg_positive": "positive_score",
        "avg_negative": "negative_score",
        **{f"avg_{name}": name for name in V.DAILY_EMOTIONS},
    }
    daily = stg_emotion_days(staged).groupBy("date_key").agg(
        *[F.avg(source).alias(name) for name, source in measures.items()],
        F.count(F.lit(1)).alias("article_count"),
    )
    return daily.select(
        "date_key",
        schemas.event_day(F.col("date_key")).alias("event_date"),
        *[round_half_away(F.col(name), 2).alias(name) for name in measures],
        "article_count",
    ).orderBy(F.col("date_key").desc_nulls_last())


def exploded_themes(staged: DataFrame) -> DataFrame:
    """One row per mentioned theme with its day."""
    return stg_emotion_days(staged).select(
        "date_key", F.explode(packed.theme_items(F.col("themes"))).alias("theme")
    )


def theme_days(staged: DataFrame) -> DataFrame:
    """Mentions per theme and day."""
    return exploded_themes(staged).groupBy("theme", "date_key").agg(F.count(F.lit(1)).alias("mentions"))


def fct_trending_themes(staged: DataFrame, min_count: int = 10, n: int | None = 100) -> DataFrame:
    """Most mentioned themes with active days and mentions per active day; from staged rows or their theme days.

    Mentions are first counted per (theme, day), which makes the distinct day count a
    plain count over few rows.
    """
    per_day = staged if "mentions" in staged.columns else theme_days(staged)
    themes = (
        per_day.groupBy("theme")
        .agg(F.sum("mentions").alias("mention_count"), F.count("date_key").alias("days_active"))
        .filter(F.col("mention_count") >= min_count)
        .withColumn(
            "avg_daily_mentions",
            round_half_away(
                F.try_divide(F.col("mention_count").cast("double"), F.col("days_active").cast("double")), 1
            ),
        )
    )
    # the whole mart is stored unordered
    return themes if n is None else themes.orderBy(F.col("mention_count").desc(), F.col("theme")).limit(n)
