"""Ranked story lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from presswire import schemas
from presswire.functions import headlines, labels
from presswire.operators.cleaning import clean_headlines, dedupe_headlines, drop_poor_headlines, keep_first
from presswire.operators.countries import region_label

FEED_ROWS, TRENDING_ROWS = 50, 20


STORY_COLUMNS = [
    "EVENT_ID", "DATE", "HEADLINE", "ACTOR_COUNTRY_CODE", "IMPACT_SCORE", "ARTICLE_COUNT", "NEWS_LINK", "QUALITY",
]


def story_score(df: DataFrame, span: Column | None = None) -> DataFrame:
    """Add SCORE: 60 % recency within the date range of `df`, 40 % headline quality.

    The date range (`lo`, `hi`) is one scalar subquery over `df`, computed once and not a window,
    unless `span` gives it.
    """
    dated = df.withColumn("_day", schemas.event_day(F.col("DATE")))
    if span is None:
        span = dated.agg(F.struct(F.min("_day").alias("lo"), F.max("_day").alias("hi"))).scalar()
    placed = dated.withColumn("_span", span)
    days = F.date_diff(F.col("_span.hi"), F.col("_span.lo"))
    recency = F.date_diff(F.col("_day"), F.col("_span.lo")) / F.when(days == 0, F.lit(1)).otherwise(days)
    score = F.lit(0.6) * recency + F.lit(0.4) * F.col("QUALITY")
    return placed.withColumn("SCORE", score).drop("_day", "_span")


def best_by_day(stories: DataFrame) -> DataFrame:
    """Best row of each near-duplicate headline and day: no other can have the headline's best score.

    Within a day the score follows the quality; without a day there is none and the smallest id is first.
    """
    dated = stories.withColumns({
        "_day": schemas.event_day(F.col("DATE")), "_key": headlines.dedupe_key(F.col("HEADLINE"))})
    quality = F.when(F.col("_day").isNotNull(), F.col("QUALITY"))
    return keep_first(dated, [F.col("_key"), F.col("_day")], [quality.desc_nulls_last(), F.col("EVENT_ID")])


def _day_range(best: DataFrame) -> Column:
    """First and last day of `best`.

    All columns are named and no row is filtered, so that this subquery needs the very rows that
    `best` shuffles for the stories themselves: Spark then reads that exchange twice, and cleans
    every headline once.
    """
    row = F.when(F.col("_day").isNotNull(), F.struct("_day", *[c for c in best.columns if c != "_day"]))
    return best.agg(F.struct(F.min(row)["_day"].alias("lo"), F.max(row)["_day"].alias("hi"))).scalar()


def process_stories(stories: DataFrame, iso: DataFrame, n: int = FEED_ROWS) -> DataFrame:
    """Display-ready stories: clean, drop poor ones, score, dedupe, label, keep the top `n`."""
    best = best_by_day(drop_poor_headlines(clean_headlines(stories)).select(*STORY_COLUMNS))
    scored = story_score(best.drop("_day", "_key"), _day_range(best))
    order = [F.col("SCORE").desc_nulls_last(), F.col("EVENT_ID")]
    top = dedupe_headlines(scored, order).orderBy(*order).limit(n)
    return region_label(top, iso).select(
        "EVENT_ID", "DATE", "HEADLINE", "REGION", "IMPACT_SCORE", "ARTICLE_COUNT", "NEWS_LINK",
        F.date_format(schemas.event_day(F.col("DATE")), "dd/MM").alias("DATE_FMT"),
        labels.tone_flag(F.col("IMPACT_SCORE")).alias("TONE"),
        labels.intensity_label(F.col("IMPACT_SCORE")).alias("INTENSITY"),
        "QUALITY", "SCORE",
    )
