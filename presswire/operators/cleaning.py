"""Display headlines: cleaning, quality and near-duplicate removal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from presswire.functions import headlines


def with_accepted(
    df: DataFrame, name: str, value: Column, accept: Callable[[Column], Column] = Column.isNotNull
) -> DataFrame:
    """Add a costly column and keep the rows where it is acceptable.

    A one-element generator computes the value once per row. A filter on a computed column
    would be pushed below the projection and compute it a second time.
    """
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.filter(F.array(value), accept)).alias(name)).select(
        *(df.columns if name in df.columns else [*kept, name])
    )


def with_clean_headline(df: DataFrame, source: str, target: str) -> DataFrame:
    """Add the cleaned form of a text column, NULL when it is no usable headline."""
    return df.withColumn(target, headlines.clean_headline(F.col(source)))


def with_best_headline(df: DataFrame) -> DataFrame:
    """Replace HEADLINE by the stored or URL headline, cleaned, NULL when there is none."""
    return df.withColumn("HEADLINE", headlines.best_headline(F.col("HEADLINE"), F.col("NEWS_LINK")))


def clean_headlines(events: DataFrame) -> DataFrame:
    """Events with their display headline; rows without one are dropped."""
    return with_accepted(events, "HEADLINE", headlines.best_headline(F.col("HEADLINE"), F.col("NEWS_LINK")))


def with_quality(df: DataFrame, name: str = "QUALITY") -> DataFrame:
    return df.withColumn(name, headlines.headline_quality(F.col("HEADLINE"), F.col("NEWS_LINK")))


def headline_quality_by_day(events: DataFrame) -> DataFrame:
    """Per day: cleaned headlines, mean quality, share below 0.3, share with garbage words."""
    scored = with_quality(clean_headlines(events)).withColumn(
        "_garbage", headlines.garbage_words(F.col("HEADLINE")) >= 2
    )
    return scored.groupBy("DATE").agg(
        F.count(F.lit(1)).alias("headlines"),
        F.avg("QUALITY").alias("avg_quality"),
        F.avg((F.col("QUALITY") < 0.3).cast("int")).alias("low_quality_share"),
        F.avg(F.col("_garbage").cast("int")).alias("garbage_share"),
    )


def keep_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """First row per key under a total order; groups are cut to one row before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter(F.col("_rn") == 1).drop("_rn")


def dedupe_headlines(df: DataFrame, order: list[Column]) -> DataFrame:
    """First row per near-duplicate headline key, in score order."""
    keyed = df.filter(F.length("HEADLINE") > 0).withColumn("_key", headlines.dedupe_key(F.col("HEADLINE")))
    return keep_first(keyed, [F.col("_key")], order).drop("_key")


def dedupe_stories(events: DataFrame) -> DataFrame:
    """Cleaned events, one per near-duplicate headline: most articles, then newest."""
    return dedupe_headlines(
        clean_headlines(events),
        [
            F.col("ARTICLE_COUNT").desc_nulls_last(),
            F.col("DATE").desc_nulls_last(),
            F.col("EVENT_ID"),
        ],
    )


def drop_poor_headlines(df: DataFrame, floor: float = 0.3) -> DataFrame:
    """Add QUALITY and keep rows at or above `floor`."""
    quality = headlines.headline_quality(F.col("HEADLINE"), F.col("NEWS_LINK"))
    return with_accepted(df, "QUALITY", quality, lambda q: q >= floor)
