"""Fixed table schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, types as T, functions as F

from presswire.functions import fixed_values as V

EVENTS_RAW = T.StructType(
    [
        T.StructField("EVENT_ID", T.StringType()),
        T.StructField("DATE", T.StringType()),
        T.StructField("MAIN_ACTOR", T.StringType()),
        T.StructField("ACTOR_COUNTRY_CODE", T.StringType()),
        T.StructField("EVENT_CATEGORY_CODE", T.DoubleType()),
        T.StructField("IMPACT_SCORE", T.DoubleType()),
        T.StructField("ARTICLE_COUNT", T.DoubleType()),
        T.StructField("SENTIMENT_SCORE", T.DoubleType()),
        T.StructField("NEWS_LINK", T.StringType()),
        T.StructField("HEADLINE", T.StringType()),
        T.StructField("EMBEDDING", T.ArrayType(T.DoubleType())),
    ]
)

GKG_RAW = T.StructType(
    [
        T.StructField("GKG_ID", T.StringType()),
        T.StructField("DATE", T.LongType()),
        T.StructField("SOURCE", T.StringType()),
        T.StructField("PERSONS", T.StringType()),
        T.StructField("ORGS", T.StringType()),
        T.StructField("AVG_TONE", T.DoubleType()),
        T.StructField("POSITIVE_SCORE", T.DoubleType()),
        T.StructField("NEGATIVE_SCORE", T.DoubleType()),
        *[
            T.StructField(f"EMOTION_{name.upper()}", T.DoubleType())
            for name in V.GCAM_EMOTIONS.values()
        ],
        T.StructField("TOP_THEMES", T.StringType()),
    ]
)

NUMERIC_EVENT_COLUMNS = [
    "EVENT_CATEGORY_CODE", "IMPACT_SCORE", "ARTICLE_COUNT", "SENTIMENT_SCORE",
]


def feed_schema(layout: dict[int, str], width: int) -> T.StructType:
    """All-string schema of a headerless feed; unnamed ordinals are never selected."""
    return T.StructType(
        [T.StructField(layout.get(i, f"_{i}"), T.StringType()) for i in range(width)]
    )


def event_day(date_column: Column) -> Column:
    """`YYYYMMDD` text as a date, NULL when it is not one."""
    return F.try_to_date(date_column, "yyyyMMdd")
