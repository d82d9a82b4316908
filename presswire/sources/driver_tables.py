"""Adapters from the benchmark tables to the shapes of the news and emotion feeds.

The expressions use the SQL that Spark and DuckDB share, so an oracle can start from
the same text (`EVENTS_SQL`, `ARTICLES_SQL`, `GKG_FEED_SQL`).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from presswire import schemas

SLUGS = [
    "global-markets-rally-after-central-bank-decision",
    "ministers-meet-for-border-security-talks-in-geneva",
    "flood-warning-issued-across-northern-river-valleys",
    "protesters-gather-outside-parliament-over-fuel-prices",
    "peace-agreement-signed-between-neighbouring-states",
    "1234567890",
    "article-12ab34cd",
    "short-note",
]
COUNTRIES = ["USA", "RUS", "CHN", "IND", "UKR", "ISR", "GBR", "FRA", "AFR", "USA"]
_GCAM_CODES = ["c9.1", "c9.2", "c9.3", "c9.4", "c9.5", "c9.6", "c9.7", "c9.8",
               "c18.1", "c18.2", "c18.3"]


def _case(key: str, options: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(options))
    return f"CASE {key} {whens} END"


_SLUG = _case("(event_id % 8)", SLUGS)
_LINK = (
    "'https://www.example.com/2024/01/' || {amp}" + f"{_SLUG}"
    " || '-' || CAST(100000 + event_id AS STRING) || '.html'"
)
_EVENT_FIELDS = f"""
    CAST(event_id AS STRING) AS EVENT_ID,
    replace(CAST(CAST(ts AS DATE) AS STRING), '-', '') AS DATE,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'ACTOR ' || CAST(user_id AS STRING) END AS MAIN_ACTOR,
    {_case("((event_id * 7) % 11)", COUNTRIES)} AS ACTOR_COUNTRY_CODE,
    CAST(1 + event_id % 4 AS DOUBLE) AS EVENT_CATEGORY_CODE,
    CASE WHEN event_id % 29 = 0 THEN NULL
         ELSE CAST((event_id * 37) % 201 - 100 AS DOUBLE) / 10 END AS IMPACT_SCORE,
    CAST(1 + (event_id * 13) % 40 AS DOUBLE) AS ARTICLE_COUNT,
    CAST((event_id * 53) % 401 - 200 AS DOUBLE) / 10 AS SENTIMENT_SCORE,"""
_HEADLINE = (
    f"CASE WHEN event_id % 8 >= 5 THEN NULL ELSE replace({_SLUG}, '-', ' ')"
    " || CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN ' today' ELSE ' officials confirm' END END"
)

_EVENT_SELECT = f"""
SELECT {_EVENT_FIELDS}
    {_LINK.format(amp="")} AS NEWS_LINK,
    {_HEADLINE} AS HEADLINE,"""
# every vector of the table is given to some event
EVENTS_SQL = f"""{_EVENT_SELECT}
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE v.embedding END AS EMBEDDING
FROM (SELECT *, event_id % (SELECT max(vec_id) + 1 FROM embeddings) AS slot FROM events) e
LEFT JOIN embeddings v ON v.vec_id = e.slot"""

# raw feed rows: every event once, plus a second article for every seventh one
ARTICLES_SQL = f"""
SELECT {_EVENT_FIELDS} {_LINK.format(amp="")} AS NEWS_LINK FROM events
UNION ALL
SELECT {_EVENT_FIELDS} {_LINK.format(amp="'amp/' || ")} AS NEWS_LINK FROM events
WHERE event_id % 7 = 0"""

GKG_FEED_SQL = f"""
SELECT '20240101-' || CAST(doc_id AS STRING) AS GKG_ID,
    CAST(20240101000000 + (doc_id % 30) * 1000000 + ((doc_id * 7) % 24) * 10000 AS BIGINT) AS DATE,
    source AS SOURCE,
    CASE doc_id % 4 WHEN 0 THEN 'TERROR,12;ARREST,40;EPU_POLICY,77' WHEN 1 THEN 'PROTEST,3;LEADER,9'
         WHEN 2 THEN 'EDUCATION,5;GENERAL_HEALTH,8;XX,1' END AS THEMES,
    CAST(NULL AS STRING) AS PERSONS,
    CAST(NULL AS STRING) AS ORGS,
    CASE WHEN doc_id % 19 = 0 THEN 'bad'
         ELSE CAST((doc_id * 11) % 13 - 6 AS STRING) || ',' || CAST(doc_id % 5 AS STRING)
              || ',' || CAST(doc_id % 7 AS STRING) || ',1,2,0' END AS TONE,
    'wc:120' || {" || ".join(
        f"',{code}:' || CAST((doc_id * {7 + 2 * i}) % {31 + i} AS STRING)"
        for i, code in enumerate(_GCAM_CODES))} AS GCAM
FROM documents"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of these single-file tables to all cores for CPU-heavy work.

    They are dealt by a hash: dealt in turn, every task would first sort all rows of its file in memory.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *df.columns)


def _source_events(spark: SparkSession, sf_dir: str, since: dt.date | None, wide: bool) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    if since is not None:
        events = events.filter(F.col("ts") >= F.lit(dt.datetime.combine(since, dt.time())).cast("timestamp_ntz"))
    return spread(events) if wide else events


def events_raw(
    spark: SparkSession,
    sf_dir: str,
    since: dt.date | None = None,
    vectors: bool = False,
    wide: bool = False,
) -> DataFrame:
    """Stored events. `since` bounds the scan, `vectors` adds EMBEDDING values,
    `wide` spreads the rows for string-heavy work."""
    source = _source_events(spark, sf_dir, since, wide)
    if vectors:
        known = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
        text = (
            EVENTS_SQL.replace("FROM events)", "FROM {events})").replace("FROM embeddings)", "FROM {embeddings})")
            .replace("JOIN embeddings v", "JOIN {embeddings} v")
        )
        shaped = spark.sql(text, events=source, embeddings=known)
    else:
        shaped = spark.sql(f"{_EVENT_SELECT} NULL AS EMBEDDING FROM {{events}}", events=source)
    return shaped.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.EVENTS_RAW])


def articles_raw(spark: SparkSession, sf_dir: str, wide: bool = True) -> DataFrame:
    """Feed rows before deduplication: some events have two articles."""
    return spark.sql(
        ARTICLES_SQL.replace("FROM events", "FROM {events}"),
        events=_source_events(spark, sf_dir, None, wide),
    )


def gkg_feed(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return spark.sql(
        GKG_FEED_SQL.replace("FROM documents", "FROM {documents}"),
        documents=spread(docs) if wide else docs,
    )


def feed_lines(rows: DataFrame, layout: dict[int, str], width: int) -> DataFrame:
    """Tab-separated feed fields for `rows`, padded to the full width."""
    return rows.select(
        *[
            (F.col(layout[i]) if i in layout else F.lit("")).cast("string").alias(f"_{i}")
            for i in range(width)
        ]
    )
