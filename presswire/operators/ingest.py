"""From raw feed rows to one clean row per event."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from presswire.functions import headlines, packed
from presswire.functions import fixed_values as V


def article_counts(raw: DataFrame, key: str = "EVENT_ID") -> DataFrame:
    """Feed rows per event before deduplication."""
    return raw.groupBy(key).agg(F.count(F.lit(1)).alias("OUR_ARTICLE_COUNT"))


def best_row_per_event(with_headline: DataFrame, key: str = "EVENT_ID") -> DataFrame:
    """One row per key: a headline first, then the longest, then the smallest link.

    Adds OUR_ARTICLE_COUNT, the number of rows per key. Both come from one aggregation
    that combines on the map side, so a key with very many rows never meets in one task.
    """
    others = [c for c in with_headline.columns if c not in (key, "HEADLINE", "NEWS_LINK")]
    candidate = F.struct(
        F.col("HEADLINE").isNull().alias("_no_headline"),
        (-F.coalesce(F.length("HEADLINE"), F.lit(0))).alias("_shortness"),
        F.col("NEWS_LINK").isNull().alias("_no_link"),
        "NEWS_LINK",
        "HEADLINE",
        *others,
    )
    best = with_headline.groupBy(key).agg(
        F.min(candidate).alias("_best"), F.count(F.lit(1)).alias("OUR_ARTICLE_COUNT")
    )
    kept = [F.col(key) if c == key else F.col(f"_best.{c}").alias(c) for c in with_headline.columns]
    return best.select(*kept, "OUR_ARTICLE_COUNT")


def article_count_fix(best: DataFrame) -> DataFrame:
    """Raise ARTICLE_COUNT to the counted rows when those are more; NULL stays NULL."""
    counted, stated = F.col("OUR_ARTICLE_COUNT"), F.col("ARTICLE_COUNT")
    return best.withColumn(
        "ARTICLE_COUNT", F.when(counted > stated, counted.cast("double")).otherwise(stated)
    ).drop("OUR_ARTICLE_COUNT")


def extract_headlines(raw: DataFrame) -> DataFrame:
    """Raw feed rows to one row per event with its best headline and article count."""
    named = raw.filter(F.col("EVENT_ID").isNotNull()).withColumn(
        "HEADLINE", headlines.headline_from_url(F.col("NEWS_LINK"))
    )
    return article_count_fix(best_row_per_event(named))


def parse_gkg(feed: DataFrame) -> DataFrame:
    """Emotion feed rows with tone, emotions and themes unpacked; rows without id dropped."""
    unpacked = feed.filter(F.col("GKG_ID").isNotNull()).withColumn(
        "_pairs", packed.gcam_pairs(F.col("GCAM"))
    )
    return unpacked.select(
        "GKG_ID", "DATE", "SOURCE", "PERSONS", "ORGS",
        *[column.alias(name) for name, column in packed.parse_tone(F.col("TONE")).items()],
        *[
            packed.emotion_value(F.col("_pairs"), code).alias(f"EMOTION_{name.upper()}")
            for code, name in V.GCAM_EMOTIONS.items()
        ],
        packed.parse_themes(F.col("THEMES")).alias("TOP_THEMES"),
    )
