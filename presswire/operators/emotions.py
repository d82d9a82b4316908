"""Emotion dashboard: the 24 hours before an explicit `as_of`, floored to the hour."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from presswire.functions import fixed_values as V
from presswire.functions import labels, packed
from presswire.functions.dates import hour_floor_cutoff, since_cutoff


def last_day(gkg: DataFrame, as_of: dt.datetime) -> DataFrame:
    return since_cutoff(gkg, hour_floor_cutoff(as_of))


def _mean(column: str) -> Column:
    """Average, 0.0 when there is nothing to average."""
    return F.coalesce(F.avg(column), F.lit(0.0))


def emotion_pulse(gkg: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Mean mood, four mean emotions, articles and the mood label."""
    return (
        last_day(gkg, as_of)
        .agg(
            _mean("AVG_TONE").alias("avg_mood"),
            F.avg("EMOTION_FEAR").alias("avg_fear"),
            F.avg("EMOTION_JOY").alias("avg_joy"),
            F.avg("EMOTION_ANGER").alias("avg_anger"),
            F.avg("EMOTION_TRUST").alias("avg_trust"),
            F.count(F.lit(1)).alias("article_count"),
        )
        .withColumn("mood_label", labels.mood_label(F.col("avg_mood")))
    )


def emotion_radar(gkg: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Seven mean emotions and the strongest one; the first in order wins a tie."""
    means = last_day(gkg, as_of).agg(
        *[_mean(f"EMOTION_{name.upper()}").alias(name) for name in V.RADAR_EMOTIONS]
    )
    top = F.greatest(*V.RADAR_EMOTIONS)
    dominant = F.coalesce(
        *[F.when(F.col(name) == top, F.lit(name.capitalize())) for name in V.RADAR_EMOTIONS]
    )
    return means.withColumns({"dominant": dominant, "dominant_value": top})


def emotion_stats(gkg: DataFrame, as_of: dt.datetime) -> DataFrame:
    return last_day(gkg, as_of).agg(
        F.count(F.lit(1)).alias("total_articles"),
        _mean("POSITIVE_SCORE").alias("avg_positive"),
        _mean("NEGATIVE_SCORE").alias("avg_negative"),
        _mean("EMOTION_FEAR").alias("avg_fear"),
        _mean("EMOTION_JOY").alias("avg_joy"),
    )


def emotion_insight(gkg: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Which way the news leans: fear, joy, a negative or positive tone, or balanced."""
    means = last_day(gkg, as_of).agg(
        _mean("AVG_TONE").alias("tone"),
        _mean("EMOTION_FEAR").alias("fear"),
        _mean("EMOTION_JOY").alias("joy"),
        _mean("EMOTION_ANGER").alias("anger"),
        F.count(F.lit(1)).alias("cnt"),
    )
    return means.withColumn(
        "insight",
        F.when(F.col("fear") > F.col("joy") * 1.5, "fear")
        .when(F.col("joy") > F.col("fear") * 1.5, "joy")
        .when(F.col("tone") < -2, "negative")
        .when(F.col("tone") > 2, "positive")
        .otherwise("balanced"),
    )


def trending_topics(gkg: DataFrame, as_of: dt.datetime, n: int = 8) -> DataFrame:
    """Most mentioned topics by readable label; codes with one label add up."""
    mentions = (
        last_day(gkg, as_of)
        .select(F.explode(packed.theme_items(F.col("TOP_THEMES"))).alias("theme"))
        .groupBy("theme").agg(F.count(F.lit(1)).alias("mentions"))
    )
    labelled = mentions.withColumn("label", packed.humanize_theme(F.col("theme"))).filter("label IS NOT NULL")
    return (
        labelled.groupBy("label").agg(F.sum("mentions").alias("mentions"))
        .orderBy(F.col("mentions").desc(), F.col("label"))
        .limit(n)
    )
