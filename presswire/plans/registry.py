"""Named queries over the benchmark tables, one per operator."""

from __future__ import annotations

import datetime as dt
import io
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from presswire.functions import dates, fixed_values as V
from presswire.functions import headlines as H
from presswire.functions import labels
from presswire.functions.numeric import stable_round
from presswire.functions.vectors import cosine_similarity
from presswire.operators import (
    cleaning, countries, dashboard, embedding, emotions, ingest, labelling, lookups, marts, quality,
    question_search, search, staging, stories,
)
from presswire.plans import incremental, models
from presswire.session import work_path
from presswire.sources import feeds, tables
from presswire.sources.driver_tables import articles_raw, events_raw, feed_lines, gkg_feed, spread, table
from presswire.streaming import counts, ingest as stream

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = dt.date(2024, 1, 30)
AS_OF_TIME = dt.datetime(2024, 1, 30, 23, 0)
RETENTION_AS_OF = dt.date(2024, 2, 15)
SLOTS = (dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 30, 23, 45))
SPLIT_DAY, OVERLAP_DAY = "20240116", "20240110"
QUESTION = "latest peace agreement news"
MIN_DATE = dates.days_before(AS_OF, 30)
STREAM_FILES = 4
STOP_WORDS = ["the", "us", "north", "news"]

# three-letter codes given to the first rows of `nation`, which stand in for the ISO table
ISO_CODES = ["USA", "RUS", "CHN", "IND", "UKR", "ISR", "GBR", "FRA"]
# names used to try the country name look-up, by customer
NAMES = ["Russia", " chinese ", "us", "1234", "u.s.a.", "South Korea", "nation_3", "nation_9",
         "natio", "x", "atlantis", "the"]


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Cut float noise of summation order so that engines can be compared."""
    return df.withColumns({c: stable_round(F.col(c)) for c in columns})


def iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nations: the first with real codes, the others with made-up ones of their own."""
    key = F.col("n_nationkey").cast("int")
    known = F.try_element_at(F.array(*map(F.lit, ISO_CODES)), key + 1)
    return table(spark, sf_dir, "nation").select(
        F.coalesce(F.substring(known, 1, 2), F.concat(F.char(key + 65), F.lit("X"))).alias("alpha2"),
        F.coalesce(known, F.concat(F.lit("N"), F.lpad(key.cast("string"), 2, "0"))).alias("alpha3"),
        F.col("n_name").alias("name"),
    )


def gkg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.parse_gkg(gkg_feed(spark, sf_dir, wide=True))


def week(spark: SparkSession, sf_dir: str, days: int = 7) -> DataFrame:
    return events_raw(spark, sf_dir, since=AS_OF - dt.timedelta(days=days))


def staged(spark: SparkSession, sf_dir: str, vectors: bool = False) -> DataFrame:
    return staging.stg_events(events_raw(spark, sf_dir, vectors=vectors))


def staged_emotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.stg_emotions(gkg(spark, sf_dir))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0, scale: float = 1.0) -> Column:
    """A stored vector as a scalar subquery; `scale` 0.0 makes a zero vector of it."""
    vectors = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id)
    return vectors.select(F.transform("embedding", lambda v: v.cast("double") * scale)).scalar()


def with_similarity(df: DataFrame, vector: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = df.withColumn("_asked", query_vector(spark, sf_dir))
    return asked.withColumn("similarity", cosine_similarity(F.col(vector), F.col("_asked"))).drop("_asked")


def request(spark: SparkSession, sf_dir: str) -> search.SearchRequest:
    return search.SearchRequest(1, QUESTION, query_vector(spark, sf_dir))


def vector_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_raw(spark, sf_dir, vectors=True)


def without_vector(events: DataFrame) -> DataFrame:
    return events.drop("EMBEDDING")


# -- sources and sinks --------------------------------------------------------

def written_event_feed(spark: SparkSession, sf_dir: str, files: int | None = None) -> str:
    path = work_path(spark, "event-feed")
    lines = feed_lines(articles_raw(spark, sf_dir), V.EVENT_FEED_COLUMNS, V.EVENT_FEED_WIDTH)
    lines = lines if files is None else lines.repartition(files, "_0")
    lines.write.option("sep", "\t").csv(path)
    return path


def written_gkg_feed(spark: SparkSession, sf_dir: str, files: int | None = None) -> str:
    path = work_path(spark, "gkg-feed")
    lines = feed_lines(gkg_feed(spark, sf_dir, wide=True), V.GKG_FEED_COLUMNS, V.GKG_FEED_WIDTH)
    lines = lines if files is None else lines.repartition(files)
    lines.write.option("sep", "\t").csv(path)
    return path


def zipped_files(lines: DataFrame) -> DataFrame:
    """One archive per batch of feed lines, shaped like the `binaryFile` source."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("feed.csv", "\n".join(frame["line"]) + "\n")
            yield pd.DataFrame({"content": [buffer.getvalue()]})

    joined = F.concat_ws("\t", *[F.coalesce(F.col(c), F.lit("")) for c in lines.columns])
    return lines.select(joined.alias("line")).mapInPandas(pack, "content binary")


def q_read_zipped_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = feed_lines(articles_raw(spark, sf_dir), V.EVENT_FEED_COLUMNS, V.EVENT_FEED_WIDTH)
    return feeds.zipped_events(zipped_files(lines))


def q_missing_feed_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("ts")
    slot = F.date_trunc("hour", "ts") + F.make_dt_interval(mins=F.floor(F.minute("ts") / 15).cast("int") * 15)
    landed = events.select(feeds.slot_name(slot, "events").alias("file_name"))
    return feeds.missing_slots(landed, *SLOTS).select("feed", "file_name")


def q_append_new_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, path = without_vector(events_raw(spark, sf_dir)), work_path(spark, "events")
    tables.append_new_events(events.filter(F.col("DATE") < SPLIT_DAY), path)
    later = events.filter(F.col("DATE") >= OVERLAP_DAY)
    changed = later.withColumn("ARTICLE_COUNT", F.col("ARTICLE_COUNT") + 100)
    return without_vector(tables.append_new_events(changed, path))


def q_append_moved_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four loads in which ids come again under earlier and later days, and with changed rows."""
    events, path = without_vector(events_raw(spark, sf_dir)), work_path(spark, "events")
    some = F.col("EVENT_ID").cast("bigint")
    tables.append_new_events(events.filter((F.col("DATE") < SPLIT_DAY) & (some % 5 > 0)), path)
    tables.append_new_events(events.filter(some % 3 == 0).withColumn("DATE", F.lit("20231231")), path)
    tables.append_new_events(events.withColumn("DATE", F.lit("20240229")).filter(some % 7 == 0), path)
    stored = tables.append_new_events(events.withColumn("ARTICLE_COUNT", F.lit(0.0)), path)
    return stored.select("EVENT_ID", "DATE", "ARTICLE_COUNT")


def q_append_new_gkg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = gkg(spark, sf_dir), work_path(spark, "gkg")
    tables.append_new_gkg(rows.filter(F.col("DATE") < 20240116000000), path)
    changed = rows.filter(F.col("DATE") >= 20240110000000).withColumn("AVG_TONE", F.col("AVG_TONE") + 100)
    return tables.append_new_gkg(changed, path, RETENTION_AS_OF).select(
        "GKG_ID", "DATE", "AVG_TONE", "TOP_THEMES"
    )


def new_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector for each event that has none yet."""
    waiting = vector_events(spark, sf_dir).filter(F.col("EMBEDDING").isNull()).select("EVENT_ID", "DATE")
    vectors = table(spark, sf_dir, "embeddings")
    known = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("EMBEDDING"))
    slot = F.col("EVENT_ID").cast("bigint") % vectors.agg(F.max("vec_id") + 1).scalar()
    placed = waiting.withColumn("_slot", slot)
    return placed.join(known, F.col("_slot") == F.col("vec_id")).select("EVENT_ID", "DATE", "EMBEDDING")


def vector_sums(events: DataFrame) -> DataFrame:
    return events.select(
        "EVENT_ID", "DATE",
        F.size("EMBEDDING").cast("bigint").alias("dims"),
        stable_round(F.aggregate("EMBEDDING", F.lit(0.0), lambda a, v: a + v)).alias("total"),
    )


def q_write_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "events")
    tables.append_new_events(vector_events(spark, sf_dir), path)
    return vector_sums(tables.write_embeddings(spark, path, new_vectors(spark, sf_dir)))


def q_register_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = work_path(spark, "marts")
    names = models.build_models(vector_events(spark, sf_dir), gkg(spark, sf_dir), root)
    measures = ["event_count", "total_events", "total_events", "article_count", "mention_count"]
    sizes = [
        spark.read.parquet(f"{root}/{name}").agg(
            F.lit(name).alias("model"), F.count(F.lit(1)).alias("n_rows"), F.sum(measure).cast("bigint").alias("total")
        )
        for name, measure in zip(names, measures)
    ]
    out = sizes[0]
    for size in sizes[1:]:
        out = out.unionByName(size)
    return out


def refreshed_marts(spark: SparkSession, sf_dir: str) -> incremental.MartStore:
    """Marts kept up by refreshes between loads: mixed days, late days, changed rows of stored keys, a repeated load."""
    root = work_path(spark, "mart-store")
    store = incremental.MartStore(spark, f"{root}/marts", f"{root}/events", f"{root}/gkg")
    # an append deals rows by key itself
    events, emotion_rows = vector_events(spark, sf_dir), gkg(spark, sf_dir)
    number, tail = F.col("EVENT_ID").cast("bigint") % 3, F.substring_index("GKG_ID", "-", -1).cast("bigint") % 3
    first = [events.filter((F.col("DATE") >= OVERLAP_DAY) & (number > 0)),
             emotion_rows.filter((F.col("DATE") >= 20240110000000) & (tail > 0))]
    late = [events.filter((F.col("DATE") < SPLIT_DAY) & (number == 0)),
            emotion_rows.filter((F.col("DATE") < 20240116000000) & (tail == 0))]
    known = ((F.col("DATE") >= OVERLAP_DAY) & (number > 0)) | ((F.col("DATE") < SPLIT_DAY) & (number == 0))
    changed = [
        events.withColumn("ARTICLE_COUNT", F.col("ARTICLE_COUNT") + F.when(known, 100.0).otherwise(0.0)),
        emotion_rows,
    ]
    for some_events, some_emotions in (first, late, changed, first):
        tables.append_new_events(some_events, store.events_path)
        tables.append_new_gkg(some_emotions, store.gkg_path)
        store.refresh()
    return store


def refreshed(name: str, *measures: str) -> Query:
    return lambda s, d: rounded(refreshed_marts(s, d).mart(name), *measures)


def q_model_test_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The declared tests of the staging views and marts; staged articles stand for a load with repeats."""
    events, emotion_rows = staged(spark, sf_dir), staged_emotions(spark, sf_dir)
    articles = articles_raw(spark, sf_dir, wide=False).withColumns(
        {"HEADLINE": F.lit(None).cast("string"), "EMBEDDING": F.lit(None).cast("array<double>")})
    declared = [
        (staging.stg_events(articles), "staged_articles", dict(unique=("event_id",), not_null=("event_id", "actor_name"))),
        (events, "stg_events", dict(
            unique=("event_id",), not_null=("event_id", "event_date_raw"),
            accepted={"sentiment_category": [
                "Very Negative", "Negative", "Neutral", "Positive", "Very Positive", "Crisis"]})),
        (emotion_rows, "stg_gkg_emotions", dict(unique=("gkg_id",), not_null=("gkg_id", "date_str"))),
        (marts.fct_daily_events(events), "fct_daily_events", dict(
            unique=("event_date_raw",), not_null=("event_date_raw", "event_count"), not_negative=("total_articles",))),
        (marts.actor_stats(events), "dim_actors", dict(unique=("actor_name",), not_null=("actor_name", "total_events"))),
        (marts.dim_countries(events), "dim_countries", dict(
            unique=("country_code",), not_null=("country_code", "total_events"))),
        (marts.fct_trending_themes(emotion_rows, n=None), "fct_trending_themes", dict(
            unique=("theme",), not_null=("theme", "mention_count"))),
    ]
    reports = [quality.model_tests(df, model, **tests) for df, model, tests in declared]
    return reduce(DataFrame.unionByName, reports)


# -- cleaning -----------------------------------------------------------------

def wide_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_vector(events_raw(spark, sf_dir, wide=True))


def q_extract_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.extract_headlines(articles_raw(spark, sf_dir))


def q_headline_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = articles_raw(spark, sf_dir).select("EVENT_ID", "NEWS_LINK")
    return linked.withColumn("HEADLINE", H.headline_from_url(F.col("NEWS_LINK")))


def q_clean_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned headline of every conversation turn, whole texts."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return cleaning.with_clean_headline(turns, "text", "headline").select("conv_id", "turn", "headline")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document with its number."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def q_headline_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = document_lines(spark, sf_dir)
    return cleaning.with_clean_headline(lines, "line", "headline").select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), "headline")


def q_headline_of_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links made of the words of document lines."""
    slug = F.replace(F.trim("line"), F.lit(" "), F.lit("-"))
    link = F.concat(F.lit("https://www.example.com/2024/01/"), slug, F.lit("-"), F.col("doc_id").cast("string"), F.lit(".html"))
    linked = document_lines(spark, sf_dir).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), link.alias("NEWS_LINK"))
    return linked.withColumn("HEADLINE", H.headline_from_url(F.col("NEWS_LINK")))


def q_headline_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", H.headline_from_url(F.col("url")).alias("HEADLINE"))


def q_title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events_raw(spark, sf_dir).select("EVENT_ID", H.title_case(F.col("HEADLINE")).alias("title"))
    return rows


def q_headline_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = cleaning.with_quality(wide_events(spark, sf_dir))
    return rounded(scored.select("EVENT_ID", "HEADLINE", "QUALITY"), "QUALITY")


def q_segment_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_raw(spark, sf_dir).select(
        "EVENT_ID", H.segment_score(F.col("HEADLINE")).cast("bigint").alias("score")
    )


def q_garbage_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", H.garbage_words(F.col("text")).cast("bigint").alias("garbage"))


def q_dedupe_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_raw(spark, sf_dir).select("EVENT_ID", H.dedupe_key(F.col("HEADLINE")).alias("dedupe_key"))


def q_headline_quality_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_day = cleaning.headline_quality_by_day(wide_events(spark, sf_dir))
    return rounded(by_day, "avg_quality", "low_quality_share", "garbage_share")


def q_process_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = dashboard.trending_week(week(spark, sf_dir), AS_OF, n=None)
    shown = stories.process_stories(top, iso(spark, sf_dir), stories.TRENDING_ROWS)
    return rounded(shown, "QUALITY", "SCORE")


def q_process_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = dashboard.feed_week(week(spark, sf_dir), AS_OF, n=None)
    return rounded(stories.process_stories(top, iso(spark, sf_dir)), "QUALITY", "SCORE")


def q_story_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = cleaning.drop_poor_headlines(cleaning.clean_headlines(wide_events(spark, sf_dir)))
    return rounded(stories.story_score(clean).select("EVENT_ID", "QUALITY", "SCORE"), "QUALITY", "SCORE")


# -- labels and lookups -------------------------------------------------------

def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelling.label_events(without_vector(events_raw(spark, sf_dir)), iso(spark, sf_dir))


def q_label_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).select(
        "EVENT_ID", "REGION", "IMPACT_LABEL", "INTENSITY", "TONE", "SEVERITY", "SENTIMENT_CATEGORY"
    )


def q_country_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.get(F.array(*map(F.lit, NAMES)), (F.col("c_custkey") % len(NAMES)).cast("int"))
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    place = F.when(F.col("c_custkey") % 5 == 0, F.col("n_name")).otherwise(names)
    people = (
        table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", place.alias("place"))
    )
    return countries.country_alias(people, "place", iso(spark, sf_dir), STOP_WORDS)


def q_country_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries named by the words of all turns; words that stand in every hundredth turn or more are stop words."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    words = turns.select("conv_id", "turn", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    per_word = words.groupBy(F.lower(F.trim("word")).alias("word")).agg(F.count(F.lit(1)).alias("n"))
    stop = per_word.filter(F.col("n") * 100 >= turns.agg(F.count(F.lit(1))).scalar()).select("word")
    nations = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("word"))
    asked = per_word.select("word").unionByName(nations).distinct()
    return countries.country_alias(asked, "word", iso(spark, sf_dir), stop)


def q_expand_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return countries.expand_regions(table(spark, sf_dir, "region").select("r_name"), "r_name")


def q_present_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookups.lookup_events(
        without_vector(events_raw(spark, sf_dir)), lookups.period(AS_OF, "month"), ["USA", "RUS"], None
    )
    order = [F.col("ARTICLE_COUNT").desc(), F.col("DATE").desc()]
    return lookups.present_events(found, iso(spark, sf_dir), order)


# -- search -------------------------------------------------------------------

def q_query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return search.query_terms(turns, "text").withColumn("position", F.col("position").cast("bigint"))


def q_score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = [search.SearchRequest(i, "", query_vector(spark, sf_dir, i)) for i in (0, 1, 2)]
    return rounded(search.score_pairs(vector_events(spark, sf_dir), requests), "similarity")


def q_cosine_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v")
    )
    return rounded(with_similarity(vectors, "v", spark, sf_dir).drop("v"), "similarity")


def q_similarity_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = vector_events(spark, sf_dir).filter("HEADLINE IS NOT NULL AND EMBEDDING IS NOT NULL")
    scored = with_similarity(known, "EMBEDDING", spark, sf_dir)
    return rounded(search.similarity_group(scored), "similarity")


def q_dedupe_best_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = vector_events(spark, sf_dir).filter("HEADLINE IS NOT NULL AND EMBEDDING IS NOT NULL")
    scored = with_similarity(known, "EMBEDDING", spark, sf_dir)
    best = search.dedupe_best_similarity(scored, F.col("EVENT_ID").asc())
    return rounded(best.select("EVENT_ID", "HEADLINE", "similarity"), "similarity")


def hits_of(find: Callable[..., DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = find(vector_events(spark, sf_dir), request(spark, sf_dir), 10, MIN_DATE)
        return rounded(found, "similarity")

    return run


def q_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = search.SearchRequest(1, QUESTION)
    return search.keyword_search(events_raw(spark, sf_dir), asked, 10, MIN_DATE).drop("similarity")


def asked_of(spark: SparkSession, sf_dir: str, *asked: tuple[str, float | None]) -> DataFrame:
    """A table of questions, each with the first stored vector scaled by its number, or without one."""
    texts = spark.createDataFrame([(i + 1, *a) for i, a in enumerate(asked)], "query_id bigint, text string, _scale double")
    scaled = F.transform("_vector", lambda v: v * F.col("_scale"))
    return texts.withColumn("_vector", query_vector(spark, sf_dir)).select("query_id", "text", scaled.alias("vector"))


def q_search_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three questions: with a vector, without one, and with a vector that finds nothing."""
    asked = asked_of(spark, sf_dir, (QUESTION, 1.0), ("flood warning in river valleys", None), ("central bank decision", 0.0))
    return rounded(question_search.search_questions(vector_events(spark, sf_dir), asked, 10, MIN_DATE), "similarity")


def q_answer_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = asked_of(spark, sf_dir, (QUESTION, 1.0))
    found = question_search.search_questions(vector_events(spark, sf_dir), asked, None, MIN_DATE)
    return search.answer_context(found, iso(spark, sf_dir))


def q_search_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every first turn of a conversation as a question; two of three have a vector."""
    turns = table(spark, sf_dir, "conversations").filter("turn = 0").select("conv_id", "text")
    vectors = table(spark, sf_dir, "embeddings")
    known = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("_vector"))
    slot = F.col("conv_id") % vectors.agg(F.max("vec_id") + 1).scalar()
    asked = turns.withColumn("_slot", slot).join(known, F.col("_slot") == F.col("vec_id")).select(
        F.col("conv_id").alias("query_id"), "text", F.when(F.col("conv_id") % 3 != 0, F.col("_vector")).alias("vector"))
    found = question_search.search_questions(events_raw(spark, sf_dir, vectors=True, wide=True), asked, 10, MIN_DATE)
    return rounded(found, "similarity")


def letter_counts(texts: list[str]) -> list[list[float]]:
    """Stand-in embedder: how often each letter occurs."""
    return [[float(t.lower().count(chr(97 + i))) for i in range(26)] for t in texts]


def q_embed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    waiting = embedding.pending_embeddings(vector_events(spark, sf_dir))
    done = embedding.embed_batch(embedding.embedding_inputs(waiting), letter_counts)
    weighted = F.aggregate(
        F.transform("EMBEDDING", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v
    )
    return done.select("EVENT_ID", F.size("EMBEDDING").cast("bigint").alias("dims"), weighted.alias("checksum"))


# -- streaming ----------------------------------------------------------------

def q_stream_ingest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file per batch; the files mix days and each holds all articles of its events."""
    table_path = work_path(spark, "stream-events")
    stream.stream_ingest_events(
        spark, written_event_feed(spark, sf_dir, STREAM_FILES), table_path, work_path(spark, "checkpoint"),
        files_per_batch=1,
    ).awaitTermination()
    return without_vector(tables.read_events(spark, table_path))


def q_stream_ingest_gkg(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_path = work_path(spark, "stream-gkg")
    stream.stream_ingest_gkg(
        spark, written_gkg_feed(spark, sf_dir, STREAM_FILES), table_path, work_path(spark, "checkpoint"),
        files_per_batch=1,
    ).awaitTermination()
    return tables.read_gkg(spark, table_path).drop(tables.GKG_PARTITION)


def q_stream_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_path = work_path(spark, "stream-gkg")
    tables.append_new_gkg(gkg(spark, sf_dir), table_path)
    trigger = spark.readStream.schema(feeds.gkg_feed_schema()).options(**feeds.CSV_OPTIONS).csv(
        written_gkg_feed(spark, sf_dir)
    )
    (
        trigger.writeStream.foreachBatch(stream.stream_retention(lambda: RETENTION_AS_OF, table_path))
        .option("checkpointLocation", work_path(spark, "checkpoint")).trigger(availableNow=True).start()
        .awaitTermination()
    )
    return tables.read_gkg(spark, table_path).groupBy("DATE").agg(F.count(F.lit(1)).alias("n_rows"))


def q_stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = (
        spark.readStream.schema(feeds.event_feed_schema()).options(**feeds.CSV_OPTIONS)
        .option("maxFilesPerTrigger", 1).csv(written_event_feed(spark, sf_dir, STREAM_FILES))
    )
    out = work_path(spark, "deduped")
    counts.stream_dedupe(
        feeds.type_event_columns(rows).select("EVENT_ID", "DATE"), "EVENT_ID", "DATE", out,
        work_path(spark, "checkpoint"),
    ).awaitTermination()
    return spark.read.schema("EVENT_ID string, DATE string").parquet(out)


def q_stream_dedupe_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id under three days, dealt to files, one per batch: each is kept once, under one of its days."""
    events = without_vector(events_raw(spark, sf_dir)).select("EVENT_ID", "DATE")
    days = F.array(F.col("DATE"), F.lit("20231231"), F.lit("20240229"))
    landed = work_path(spark, "moved-days")
    moved = events.select("EVENT_ID", F.explode(days).alias("DATE"))
    moved.repartition(STREAM_FILES, "DATE", "EVENT_ID").write.parquet(landed)
    rows = spark.readStream.schema(moved.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    out = work_path(spark, "deduped")
    counts.stream_dedupe(rows, "EVENT_ID", "DATE", out, work_path(spark, "checkpoint")).awaitTermination()
    kept = spark.read.schema("EVENT_ID string, DATE string").parquet(out)
    own = kept.join(events.withColumnRenamed("DATE", "_own"), "EVENT_ID").withColumn(
        "_fits", F.col("DATE").isin("20231231", "20240229") | (F.col("DATE") == F.col("_own")))
    return own.groupBy("EVENT_ID").agg(F.count("*").alias("n_rows"), F.count_if("_fits").alias("n_fit"))


def q_stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events dealt to files without regard to days, one file per batch."""
    events = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    landed = work_path(spark, "landed-events")
    events.repartition(STREAM_FILES).write.parquet(landed)
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    out = work_path(spark, "daily-counts")
    counts.stream_daily_counts(rows, "ts", out, work_path(spark, "checkpoint")).awaitTermination()
    return counts.latest_daily_counts(spark, out)


def q_stream_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_path = work_path(spark, "stream-events")
    tables.append_new_events(without_vector(events_raw(spark, sf_dir)), table_path)
    return stream.stream_freshness(spark, table_path, dt.datetime(2024, 1, 30, 2, 0))


# -- the registry -------------------------------------------------------------

def single_check(*suite: quality.Expectation) -> Query:
    return lambda s, d: quality.dq_report(events_raw(s, d), list(suite))


def scored_by(rule: Callable[[Column], Column], name: str) -> Query:
    return lambda s, d: events_raw(s, d).select("EVENT_ID", rule(F.col("IMPACT_SCORE")).alias(name))


def month_lookup(find: Callable[..., DataFrame], *args, **kwargs) -> Query:
    return lambda s, d: find(
        without_vector(week(s, d, 30)), lookups.period(AS_OF, "month"), *args, **kwargs
    )


def q_dominant_emotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged_emotions(spark, sf_dir).groupBy("dominant_emotion").agg(F.count(F.lit(1)).alias("articles"))


QUERIES: dict[str, Query] = {
    # sources and sinks
    "read_event_feed": lambda s, d: feeds.read_event_feed(s, written_event_feed(s, d)),
    "read_gkg_feed": lambda s, d: feeds.read_gkg_feed(s, written_gkg_feed(s, d)),
    "read_zipped_feed": q_read_zipped_feed,
    "missing_feed_slots": q_missing_feed_slots,
    "append_new_events": q_append_new_events,
    "append_moved_days": q_append_moved_days,
    "append_new_gkg": q_append_new_gkg,
    "retention_delete": lambda s, d: tables.retain(gkg(s, d), RETENTION_AS_OF).select("GKG_ID", "DATE"),
    "write_embeddings": q_write_embeddings,
    "register_models": q_register_models,
    "load_stats": lambda s, d: tables.load_stats(vector_events(s, d), week(s, d)),
    # quality gates
    "dq_column_exists": single_check(quality.column_exists("EVENT_ID"), quality.column_exists("NO_SUCH")),
    "dq_not_null_ratio": single_check(quality.not_null_ratio("MAIN_ACTOR"), quality.not_null_ratio("EVENT_ID", 1.0)),
    "dq_unique": single_check(quality.unique("EVENT_ID"), quality.unique("MAIN_ACTOR")),
    "dq_between": single_check(quality.between("IMPACT_SCORE", -5.0, 5.0), quality.between("SENTIMENT_SCORE", -100.0, 100.0)),
    "dq_row_count": single_check(quality.row_count(100, 50_000)),
    "dq_report": lambda s, d: quality.dq_report(events_raw(s, d)),
    "dq_summary": lambda s, d: quality.dq_summary(quality.dq_report(events_raw(s, d))),
    "dq_dbt_unique": lambda s, d: quality.duplicate_keys(articles_raw(s, d, wide=False), "EVENT_ID"),
    "dq_dbt_not_null": lambda s, d: quality.null_rows(staged(s, d), "actor_name").select("event_id"),
    "dq_accepted_values": lambda s, d: quality.unexpected_values(
        staged(s, d), "sentiment_category", ["Negative", "Neutral", "Positive"]),
    "dq_positive_articles": lambda s, d: quality.negative_article_days(marts.fct_daily_events(staged(s, d))).select(
        "event_date_raw", "total_articles"),
    "model_test_report": q_model_test_report,
    "dq_freshness": lambda s, d: quality.freshness(table(s, d, "events"), F.date_trunc("second", "ts"), AS_OF_TIME),
    # staging and filters
    "stg_events": lambda s, d: staged(s, d, vectors=True).withColumn(
        "embedding_dims", F.size("embedding").cast("bigint")).drop("embedding"),
    "stg_emotions": staged_emotions,
    "dominant_emotion": q_dominant_emotion,
    "filter_recent": lambda s, d: dates.filter_recent(without_vector(week(s, d)), AS_OF, 7),
    "filter_calendar_week": lambda s, d: dates.filter_calendar_week(
        without_vector(events_raw(s, d)), AS_OF, "previous"),
    "filter_calendar_month": lambda s, d: dates.filter_calendar_month(
        without_vector(events_raw(s, d)), AS_OF, 1),
    "alerts_3d": lambda s, d: dashboard.alerts(week(s, d, 3), AS_OF),
    "trending_week": lambda s, d: dashboard.trending_week(week(s, d), AS_OF),
    "feed_week": lambda s, d: dashboard.feed_week(week(s, d), AS_OF),
    "pending_embeddings": lambda s, d: embedding.pending_embeddings(vector_events(s, d)),
    # joins and lookups
    "article_count_fix": lambda s, d: ingest.article_count_fix(ingest.best_row_per_event(
        articles_raw(s, d, wide=False).withColumn("HEADLINE", F.lit(None).cast("string")))).drop("HEADLINE"),
    "new_rows_only": lambda s, d: tables.new_rows_only(
        without_vector(events_raw(s, d)).filter(F.col("DATE") >= OVERLAP_DAY),
        without_vector(events_raw(s, d)).filter(F.col("DATE") < SPLIT_DAY), "EVENT_ID", "DATE"),
    "country_name": lambda s, d: countries.country_name(
        events_raw(s, d).select("EVENT_ID", "ACTOR_COUNTRY_CODE"), "ACTOR_COUNTRY_CODE", iso(s, d)),
    "country_alias": q_country_alias,
    "country_of_words": q_country_of_words,
    "region_expand": lambda s, d: countries.region_expand(without_vector(events_raw(s, d)), "middle east"),
    "region_members": q_expand_regions,
    "region_label": lambda s, d: countries.region_label(
        events_raw(s, d).select("EVENT_ID", "ACTOR_COUNTRY_CODE"), iso(s, d)),
    "vector_cross_score": lambda s, d: rounded(search.top_pairs(search.score_pairs(
        vector_events(s, d), [search.SearchRequest(i, "", query_vector(s, d, i)) for i in (0, 1, 2)], k=10), 10
    ).withColumn("position", F.col("position").cast("bigint")), "similarity"),
    "merge_embeddings": lambda s, d: vector_sums(tables.merge_embeddings(vector_events(s, d), new_vectors(s, d))),
    # marts
    "fct_daily_events": lambda s, d: rounded(
        marts.fct_daily_events(staged(s, d, vectors=True)),
        "avg_articles_per_event", "avg_goldstein_scale", "avg_tone"),
    "dim_actors": lambda s, d: rounded(
        marts.dim_actors(staged(s, d)), "avg_articles_per_event", "avg_goldstein_scale", "avg_tone"),
    "dim_countries": lambda s, d: rounded(
        marts.dim_countries(staged(s, d)), "avg_articles_per_event", "avg_goldstein_scale", "avg_tone"),
    "fct_daily_emotions": lambda s, d: marts.fct_daily_emotions(staged_emotions(s, d)),
    "fct_trending_themes": lambda s, d: marts.fct_trending_themes(staged_emotions(s, d)),
    "refreshed_daily_events": refreshed("fct_daily_events", "avg_articles_per_event", "avg_goldstein_scale", "avg_tone"),
    "refreshed_actors": refreshed("dim_actors", "avg_articles_per_event", "avg_goldstein_scale", "avg_tone"),
    "refreshed_countries": refreshed("dim_countries", "avg_articles_per_event", "avg_goldstein_scale", "avg_tone"),
    "refreshed_daily_emotions": refreshed("fct_daily_emotions"),
    "refreshed_themes": refreshed("fct_trending_themes"),
    "explode_themes": lambda s, d: marts.exploded_themes(staged_emotions(s, d)).groupBy("date_key", "theme").agg(
        F.count(F.lit(1)).alias("mentions")),
    # dashboard
    "weekly_metrics": lambda s, d: dashboard.weekly_metrics(week(s, d), AS_OF),
    "weekly_hotspot": lambda s, d: dashboard.weekly_hotspot(week(s, d), AS_OF),
    "dashboard_metrics": lambda s, d: dashboard.dashboard_metrics(events_raw(s, d), AS_OF),
    "countries_month": lambda s, d: dashboard.countries_month(week(s, d, 30), AS_OF),
    "timeseries_month": lambda s, d: dashboard.timeseries_month(week(s, d, 30), AS_OF),
    "sentiment_week": lambda s, d: rounded(dashboard.sentiment_week(week(s, d), AS_OF), "avg"),
    "weekly_sentiment_status": lambda s, d: rounded(dashboard.weekly_sentiment_status(week(s, d), AS_OF), "avg"),
    "actors_week": lambda s, d: rounded(dashboard.actors_week(week(s, d), AS_OF), "avg_impact"),
    "tone_distribution": lambda s, d: dashboard.tone_distribution(week(s, d), AS_OF),
    # emotions
    "parse_gkg": gkg,
    "emotion_pulse": lambda s, d: rounded(
        emotions.emotion_pulse(gkg(s, d), AS_OF_TIME),
        "avg_mood", "avg_fear", "avg_joy", "avg_anger", "avg_trust"),
    "emotion_radar": lambda s, d: rounded(
        emotions.emotion_radar(gkg(s, d), AS_OF_TIME), *V.RADAR_EMOTIONS, "dominant_value"),
    "emotion_stats": lambda s, d: rounded(
        emotions.emotion_stats(gkg(s, d), AS_OF_TIME), "avg_positive", "avg_negative", "avg_fear", "avg_joy"),
    "emotion_insight": lambda s, d: rounded(
        emotions.emotion_insight(gkg(s, d), AS_OF_TIME), "tone", "fear", "joy", "anger"),
    "trending_topics": lambda s, d: emotions.trending_topics(gkg(s, d), AS_OF_TIME),
    # headlines
    "article_counts": lambda s, d: ingest.article_counts(articles_raw(s, d, wide=False)),
    "extract_headlines": q_extract_headlines,
    "best_row_per_event": lambda s, d: ingest.best_row_per_event(q_headline_from_url(s, d)),
    "headline_from_url": q_headline_from_url,
    "headline_of_lines": q_headline_of_lines,
    "headline_of_links": q_headline_of_links,
    "headline_of_pages": q_headline_of_pages,
    "segment_score": q_segment_score,
    "clean_headline": q_clean_text_lines,
    "clean_headlines": lambda s, d: cleaning.clean_headlines(wide_events(s, d)),
    "best_headline": lambda s, d: cleaning.with_best_headline(wide_events(s, d)).select("EVENT_ID", "HEADLINE"),
    "title_case": q_title_case,
    "headline_quality": q_headline_quality,
    "headline_quality_by_day": q_headline_quality_by_day,
    "garbage_words": q_garbage_words,
    "dedupe_key": q_dedupe_key,
    "dedupe_stories": lambda s, d: cleaning.dedupe_stories(wide_events(s, d)),
    # labels and stories
    "impact_label": scored_by(labels.impact_label, "label"),
    "intensity_label": scored_by(labels.intensity_label, "label"),
    "tone_flag": scored_by(labels.tone_flag, "label"),
    "severity_tag": scored_by(labels.severity_tag, "label"),
    "label_events": q_label_events,
    "label_distribution": lambda s, d: labelling.label_distribution(labelled(s, d)),
    "story_score": q_story_score,
    "process_stories": q_process_stories,
    "process_feed": q_process_feed,
    # search
    "query_terms": q_query_terms,
    "embedding_inputs": lambda s, d: embedding.embedding_inputs(
        embedding.pending_embeddings(vector_events(s, d))),
    "embed_batch": q_embed_batch,
    "cosine_similarity": q_cosine_similarity,
    "score_pairs": q_score_pairs,
    "similarity_group": q_similarity_group,
    "dedupe_best_similarity": q_dedupe_best_similarity,
    "hybrid_search": hits_of(search.hybrid_search),
    "vector_search": hits_of(search.vector_search),
    "merged_search": hits_of(search.merged_search),
    "keyword_search": q_keyword_search,
    "search_with_fallback": q_search_with_fallback,
    "answer_context": q_answer_context,
    "search_questions": q_search_questions,
    # look-ups
    "event_count_by_filter": month_lookup(lookups.event_count_by_filter, ["USA", "RUS"]),
    "country_ranking": month_lookup(lookups.country_ranking, crisis=True, n=10),
    "lookup_crisis_by_country": month_lookup(lookups.lookup_crisis_by_country),
    "lookup_crisis_events": month_lookup(lookups.lookup_crisis_events, ["USA", "RUS"]),
    "lookup_major_events": month_lookup(lookups.lookup_major_events),
    "lookup_top_countries": month_lookup(lookups.lookup_top_countries),
    "lookup_event_count": month_lookup(lookups.lookup_event_count),
    "lookup_events": month_lookup(lookups.lookup_events, ["USA", "RUS"]),
    "present_events": q_present_events,
    # streaming
    "stream_ingest_events": q_stream_ingest_events,
    "stream_ingest_gkg": q_stream_ingest_gkg,
    "stream_dedupe": q_stream_dedupe,
    "stream_dedupe_days": q_stream_dedupe_days,
    "stream_daily_counts": q_stream_daily_counts,
    "stream_retention": q_stream_retention,
    "stream_freshness": q_stream_freshness,
}
