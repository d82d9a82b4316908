"""Staging projections over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from presswire import schemas
from presswire.functions import dates, fixed_values as V, labels


def stg_events(events: DataFrame) -> DataFrame:
    """Renamed events with date parts, sentiment bucket and coverage flags."""
    day = F.col("DATE").cast("string")
    return events.filter(F.col("EVENT_ID").isNotNull()).select(
        F.col("EVENT_ID").alias("event_id"),
        day.alias("event_date_raw"),
        F.substring(day, 1, 4).try_cast("int").alias("event_year"),
        F.substring(day, 5, 2).try_cast("int").alias("event_month"),
        F.substring(day, 7, 2).try_cast("int").alias("event_day"),
        F.col("MAIN_ACTOR").alias("actor_name"),
        F.col("ACTOR_COUNTRY_CODE").alias("actor_country_code"),
        F.col("EVENT_CATEGORY_CODE").alias("event_category_code"),
        F.col("IMPACT_SCORE").alias("goldstein_scale"),
        F.col("ARTICLE_COUNT").alias("article_count"),
        F.col("SENTIMENT_SCORE").alias("avg_tone"),
        F.col("NEWS_LINK").alias("source_url"),
        F.col("HEADLINE").alias("headline"),
        F.col("EMBEDDING").alias("embedding"),
        labels.sentiment_category(F.col("IMPACT_SCORE")).alias("sentiment_category"),
        F.col("HEADLINE").isNotNull().alias("has_headline"),
        F.col("EMBEDDING").isNotNull().alias("has_embedding"),
    )


def stg_emotions(gkg: DataFrame) -> DataFrame:
    """Renamed emotion rows with a tone bucket and the dominant emotion."""
    emotion = {name: F.col(f"EMOTION_{name.upper()}") for name in V.GCAM_EMOTIONS.values()}
    return gkg.select(
        F.col("GKG_ID").alias("gkg_id"),
        F.col("DATE").alias("date_str"),
        F.col("SOURCE").alias("source_name"),
        F.col("PERSONS").alias("persons"),
        F.col("ORGS").alias("organizations"),
        F.col("TOP_THEMES").alias("themes"),
        F.col("AVG_TONE").alias("avg_tone"),
        F.col("POSITIVE_SCORE").alias("positive_score"),
        F.col("NEGATIVE_SCORE").alias("negative_score"),
        *[column.alias(name) for name, column in emotion.items()],
        F.when(F.col("AVG_TONE") < -2, "negative")
        .when(F.col("AVG_TONE") > 2, "positive")
        .otherwise("neutral")
        .alias("sentiment_category"),
        labels.dominant_emotion({n: emotion[n] for n in V.BASIC_EMOTIONS}).alias("dominant_emotion"),
    )


def stg_emotion_days(staged: DataFrame) -> DataFrame:
    """Staged emotion rows with their `YYYYMMDD` key."""
    return staged.withColumn("date_key", dates.gkg_day(F.col("date_str")))


def with_event_date(df: DataFrame, day_column: str = "event_date_raw") -> DataFrame:
    return df.withColumn("event_date", schemas.event_day(F.col(day_column)))
