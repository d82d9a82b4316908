"""Properties of the operators, on small hand-made frames and by brute force."""

import datetime as dt
import io
import os
import zipfile

import numpy as np
from pyspark.sql import functions as F

from presswire import schemas
from presswire.functions import dates
from presswire.operators import (
    cleaning, countries, dashboard, embedding, emotions, ingest, lookups, marts, quality, search, staging, stories,
)
from presswire.operators.ranking import global_rank
from presswire.plans import registry as R
from presswire.session import work_path
from presswire.sources import feeds, tables

EVENT = "EVENT_ID string, DATE string, ARTICLE_COUNT double, NEWS_LINK string, HEADLINE string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_append_twice_adds_nothing_and_keeps_old_rows(spark):
    path = work_path(spark, "t")
    first = spark.createDataFrame([("1", "20240101", 3.0, "u", "h"), ("2", "20240102", 3.0, "u", None)], EVENT)
    tables.append_new_events(first, path)
    stored = tables.append_new_events(first, path)
    assert stored.count() == 2 and "EMBEDDING" in stored.columns
    again = spark.createDataFrame([("2", "20240102", 9.0, "v", "x"), ("3", "20240103", 1.0, "w", None)], EVENT)
    stored = tables.append_new_events(again, path)
    assert rows(stored.select("EVENT_ID", "ARTICLE_COUNT")) == [("1", 3.0), ("2", 3.0), ("3", 1.0)]


def test_new_rows_and_known_rows_make_the_batch(spark, sf_dir):
    events = R.without_vector(R.events_raw(spark, sf_dir))
    batch, stored = events.filter("DATE >= '20240110'"), events.filter("DATE < '20240116'")
    fresh = tables.new_rows_only(batch, stored, "EVENT_ID", "DATE")
    known = batch.join(stored.select("EVENT_ID"), "EVENT_ID", "left_semi")
    assert rows(fresh.select("EVENT_ID").union(known.select("EVENT_ID"))) == rows(batch.select("EVENT_ID"))


def test_retention_drops_whole_days(spark, sf_dir):
    path = work_path(spark, "g")
    stored = tables.append_new_gkg(R.gkg(spark, sf_dir), path, R.RETENTION_AS_OF)
    assert stored.agg(F.min("DATE")).first()[0] >= 20240116000000
    assert not any(d < "DATE_KEY=20240116" for d in os.listdir(path.replace("file:", "")) if d.startswith("DATE_KEY"))


def test_best_row_survives_a_hot_key(spark):
    hot = spark.range(20_000).select(
        F.lit("hot").alias("EVENT_ID"),
        F.concat(F.lit("u"), F.format_string("%05d", F.col("id"))).alias("NEWS_LINK"),
        F.when(F.col("id") % 2 == 0, F.lit("same length")).alias("HEADLINE"),
        F.lit(5.0).alias("ARTICLE_COUNT"),
    )
    got = ingest.article_count_fix(ingest.best_row_per_event(hot)).collect()
    assert [tuple(r) for r in got] == [("hot", "u00000", "same length", 20_000.0)]


def test_article_count_null_stays_null(spark):
    raw = spark.createDataFrame([("1", "20240101", None, "u", None)] * 2, EVENT)
    assert ingest.article_count_fix(ingest.best_row_per_event(raw)).first()["ARTICLE_COUNT"] is None


def test_dedupe_is_idempotent(spark, sf_dir):
    once = cleaning.dedupe_stories(R.wide_events(spark, sf_dir))
    order = [F.col("ARTICLE_COUNT").desc(), F.col("EVENT_ID")]
    assert rows(cleaning.dedupe_headlines(once, order).select("EVENT_ID")) == rows(once.select("EVENT_ID"))


def test_global_rank_is_the_sorted_position(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id") % 7).alias("v"))
    got = global_rank(df, [F.col("v").desc(), F.col("id")], "r").collect()
    expected = {row["id"]: i + 1 for i, row in enumerate(sorted(got, key=lambda x: (-x["v"], x["id"])))}
    assert {row["id"]: row["r"] for row in got} == expected


def test_quality_report_edge_cases(spark):
    empty = spark.createDataFrame([], "EVENT_ID string, DATE string, IMPACT_SCORE double")
    by = {(r["expectation"], r["column"]): r for r in quality.dq_report(empty).collect()}
    assert not by["not_null_ratio", "EVENT_ID"]["success"] and by["not_null_ratio", "EVENT_ID"]["observed"] is None
    assert by["between", "IMPACT_SCORE"]["success"]
    assert by["between", "SENTIMENT_SCORE"]["reason"] == "Column does not exist"
    assert not by["between", "SENTIMENT_SCORE"]["fails_batch"]
    assert not by["column_exists", "MAIN_ACTOR"]["success"]
    assert not quality.dq_summary(quality.dq_report(empty)).first()["passed"]
    dup = spark.createDataFrame([("a",), ("a",), (None,), (None,)], "k string")
    r = quality.dq_report(dup, [quality.unique("k"), quality.not_null_ratio("k", 0.5)]).collect()
    assert r[0]["observed"] == 2.0 and not r[0]["success"] and r[1]["success"]
    assert rows(quality.duplicate_keys(dup, "k")) == [("a", 2)]
    assert quality.null_rows(dup, "k").count() == 2


def test_freshness_states(spark):
    at = dt.datetime(2024, 1, 1, 12)
    for minutes, state in ((30, "pass"), (90, "warn"), (200, "error")):
        loaded = spark.createDataFrame([(at - dt.timedelta(minutes=minutes),)], "t timestamp_ntz")
        assert quality.freshness(loaded, F.col("t"), at).first()["status"] == state
    none = spark.createDataFrame([], "t timestamp_ntz")
    assert quality.freshness(none, F.col("t"), at).first()["status"] == "error"


def test_model_tests_hold(spark, sf_dir):
    staged = R.staged(spark, sf_dir, vectors=True)
    daily, actors, lands = marts.fct_daily_events(staged), marts.dim_actors(staged), marts.dim_countries(staged)
    assert quality.duplicate_keys(staged, "event_id").isEmpty()
    assert quality.unexpected_values(staged, "sentiment_category",
                                     ["Very Negative", "Negative", "Neutral", "Positive", "Very Positive"]).isEmpty()
    for frame, keys in ((daily, ["event_date_raw"]), (actors, ["actor_name", "actor_country_code"]), (lands, ["country_code"])):
        assert quality.duplicate_keys(frame, *keys).isEmpty()
        assert quality.null_rows(frame, keys[0]).isEmpty()
    assert quality.negative_article_days(daily).isEmpty()
    n = actors.count()
    for rank in ("event_rank", "article_rank"):
        assert rows(actors.select(rank)) == [(i + 1,) for i in range(n)]
    assert daily.filter("positive_event_pct NOT BETWEEN 0 AND 100").isEmpty()
    assert marts.fct_daily_events(staged, approx=True).count() == daily.count()


def test_zip_reader_equals_plain_reader(spark, tmp_path):
    def line(event_id, impact):
        fields = [""] * 61
        fields[0], fields[1], fields[6], fields[30], fields[31], fields[60] = event_id, "20240101", "A", impact, "3", "http://x/y"
        return "\t".join(fields)

    text = "\n".join([line("1", "-2.5"), line("2", "oops")]) + "\n"
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.csv").write_text(text)
    with zipfile.ZipFile(tmp_path / "20240101000000.export.CSV.zip", "w") as z:
        z.writestr("a.csv", text)
    plain = feeds.read_event_feed(spark, str(tmp_path / "plain"))
    zipped = feeds.read_zipped(spark, str(tmp_path / "*.zip"))
    assert rows(plain.select("EVENT_ID", "IMPACT_SCORE").fillna(99.0)) == [("1", -2.5), ("2", 99.0)]
    assert plain.exceptAll(zipped).isEmpty() and zipped.exceptAll(plain).isEmpty()


def test_ragged_gkg_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("g1\t20240101000000\tx\tsrc\n" + "g2\t20240101001500" + "\t" * 40 + "\n")
    got = feeds.read_gkg_feed(spark, str(tmp_path))
    assert rows(got.select("GKG_ID", "DATE")) == [("g1", 20240101000000), ("g2", 20240101001500)]


def test_slots():
    assert feeds.slot_start(dt.datetime(2024, 1, 1, 0, 10)) == dt.datetime(2023, 12, 31, 23, 45)


def test_calendar_bounds():
    tuesday = dt.date(2024, 1, 30)
    assert dates.calendar_week(tuesday, "current") == ("20240129", "20240204")
    assert dates.calendar_week(tuesday, "previous") == ("20240122", "20240128")
    assert dates.calendar_month(tuesday, 2) == ("20230201", "20230228")
    assert dates.hour_floor_cutoff(dt.datetime(2024, 1, 30, 23, 40)) == 20240129230000


def test_country_names(spark):
    iso = spark.createDataFrame([("FR", "FRA", "France"), ("DE", "DEU", "Germany"), ("NE", "NER", "Niger"),
                                 ("NG", "NGA", "Nigeria")], "alpha2 string, alpha3 string, name string")
    codes = spark.createDataFrame([("fr",), (" deu ",), ("AFR",), ("ZZZ",), (None,), ("F",)], "c string")
    got = {r["c"]: r["COUNTRY"] for r in countries.country_name(codes, "c", iso).collect()}
    assert got == {"fr": "France", " deu ": "Germany", "AFR": "Africa", "ZZZ": None, None: None, "F": None}
    names = spark.createDataFrame([(x,) for x in ["Nigeri", "nig", "german", "us", "99", "qq", "many", None]], "c string")
    got = {r["c"]: r["COUNTRY_CODE"] for r in countries.country_alias(names, "c", iso, ["us"]).collect()}
    assert got == {"Nigeri": "NGA", "nig": "NER", "german": "DEU", "us": None, "99": None, "qq": None,
                   "many": "DEU", None: None}
    stop = spark.createDataFrame([(" US ", 1), ("MANY", 2), (None, 3)], "w string, n int")
    some = names.unionByName(spark.createDataFrame([(None,)] * 3 + [("qq",)] * 2, "c string"))
    got = rows(countries.country_alias(some, "c", iso, stop).select(F.coalesce("c", F.lit("-")), F.coalesce("COUNTRY_CODE", F.lit("-"))))
    assert got == sorted([("Nigeri", "NGA"), ("nig", "NER"), ("german", "DEU"), ("us", "-"), ("99", "-"), ("many", "-")]
                         + [("qq", "-")] * 3 + [("-", "-")] * 4)


def test_bulk_scores_by_brute_force(spark, sf_dir):
    vectors = {r[0]: np.array(r[1]) for r in R.table(spark, sf_dir, "embeddings").select("vec_id", "embedding").collect()}
    asked = [search.SearchRequest(7, "", [float(x) for x in vectors[3]]), search.SearchRequest(8, "", None)]
    candidates = R.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("EVENT_ID"), F.col("embedding").cast("array<double>").alias("EMBEDDING"))
    got = {r["EVENT_ID"]: r["similarity"] for r in search.score_pairs(candidates, asked).collect()}
    unit = {k: v / np.linalg.norm(v) for k, v in vectors.items()}
    want = {str(k): float(v @ unit[3]) for k, v in unit.items() if v @ unit[3] >= 0.2}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_best_pairs_of_a_batch_hold_the_best_of_all(spark):
    rng = np.random.default_rng(5)
    # few distinct vectors, so that many candidates tie; small batches, so that every one cuts
    rows = [(f"{i:04d}", [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(700)]
    candidates = spark.createDataFrame(rows, "EVENT_ID string, EMBEDDING array<double>").repartition(7)
    asked = [search.SearchRequest(1, "", [1.0, 0.0, 0.0]), search.SearchRequest(2, "", [1.0, 2.0, -1.0])]
    every, best = search.score_pairs(candidates, asked), search.score_pairs(candidates, asked, k=5)
    assert best.count() < every.count()
    got, want = (sorted(map(tuple, search.top_pairs(p, 5).collect())) for p in (best, every))
    assert got == want and len(got) == 10


def test_stories_of_awkward_rows_by_two_ways(spark):
    """One row per headline and day first gives what scoring every row gives."""
    rng = np.random.default_rng(9)
    days = ["20240128", "20240129", "20240130", None, "junk"]
    titles = ["Ministers meet for border talks in geneva", "Global markets rally after bank decision",
              "Flood warning issued across river valleys", "short", None]
    rows = [(f"{i:03d}", days[rng.integers(5)], "A", ["USA", None][i % 2], 1.0, float(i % 11 - 5), float(i % 9), 0.0,
             [None, f"https://x.org/a-story-{i}.html", "https://x.org/about-the-long-story-of-many-markets"][i % 3],
             titles[rng.integers(5)], None) for i in range(300)]
    iso = spark.createDataFrame([("US", "USA", "United States")], "alpha2 string, alpha3 string, name string")
    for made in (rows, rows[:1], [(*rows[0][:1], None, *rows[0][2:])], []):
        events = spark.createDataFrame(made, schemas.EVENTS_RAW)
        order = [F.col("SCORE").desc_nulls_last(), F.col("EVENT_ID")]
        plain = cleaning.dedupe_headlines(
            stories.story_score(cleaning.drop_poor_headlines(cleaning.clean_headlines(events))), order).orderBy(*order)
        want = [(r.EVENT_ID, r.HEADLINE, r.QUALITY, r.SCORE) for r in plain.collect()]
        got = [(r.EVENT_ID, r.HEADLINE, r.QUALITY, r.SCORE) for r in stories.process_stories(events, iso, 1000).collect()]
        assert sorted(got) == sorted(want)


def test_prefilter_limit_matters_and_can_be_lifted(spark, sf_dir):
    events, asked = R.vector_events(spark, sf_dir), R.request(spark, sf_dir)
    few = search.vector_search(events, asked, 10, None, cap=5)
    everything = search.vector_search(events, asked, 100, None, cap=None)
    assert few.count() <= 5
    assert set(r[0] for r in few.select("HEADLINE").collect()) <= set(r[0] for r in everything.select("HEADLINE").collect())


def test_failed_embedder_leaves_rows_pending(spark):
    def broken(texts):
        raise RuntimeError("down")

    inputs = spark.createDataFrame([("1", "a text that is long enough"), ("2", "short")], "EVENT_ID string, text string")
    assert rows(embedding.embed_batch(inputs, broken).select("EMBEDDING").filter("EMBEDDING IS NOT NULL")) == []
    sizes = []
    done = embedding.embed_batch(inputs, lambda t: [[float(len(t))]] * len(t)).collect()
    assert {r["EVENT_ID"]: r["EMBEDDING"] for r in done} == {"1": [1.0], "2": None}


def test_missing_column_reads_as_null(spark):
    path = work_path(spark, "old")
    old = spark.createDataFrame([("1", "20240101", 3.0, "u", "h")], EVENT)
    old.write.partitionBy("DATE").parquet(path)
    assert tables.read_events(spark, path).first()["EMBEDDING"] is None
    assert [f.name for f in schemas.EVENTS_RAW] == tables.read_events(spark, path).columns


def test_staged_rows_need_an_id(spark, sf_dir):
    events = R.events_raw(spark, sf_dir).withColumn("EVENT_ID", F.when(F.col("DATE") > "20240115", F.col("EVENT_ID")))
    assert staging.stg_events(events).filter("event_id IS NULL").isEmpty()


def test_repeated_vectors_do_not_multiply_events(spark):
    events = spark.createDataFrame([("1", None), ("2", [1.0])], "EVENT_ID string, EMBEDDING array<double>")
    new = spark.createDataFrame([("1", [2.0]), ("1", [3.0]), ("2", None)], "EVENT_ID string, EMBEDDING array<double>")
    got = {r["EVENT_ID"]: r["EMBEDDING"] for r in tables.merge_embeddings(events, new).collect()}
    assert got == {"1": [3.0], "2": [1.0]} and tables.merge_embeddings(events, new).count() == 2


def test_former_limits_hold_no_longer(spark):
    """Each list is longer than the limit that once cut it."""
    day, iso = "20240129", spark.createDataFrame([("US", "USA", "United States")], "alpha2 string, alpha3 string, name string")
    rows = [(str(i), day, "ACTOR", "USA", 1.0, -5.0, 10.0 + i % 7, 0.0, f"https://x.org/{i}",
             f"Story number {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}eto about markets rally", [1.0, i / 5000])
            for i in range(2600)]
    events = spark.createDataFrame(rows, schemas.EVENTS_RAW)
    far = search.SearchRequest(1, "markets", [0.0, 1.0])
    best = search.vector_search(events, far, k=1).first()
    assert best.HEADLINE == rows[-1][9]  # the 2,600th candidate
    assert search.merged_search(events, far, k=None).count() > 500
    assert dashboard.trending_week(events, dt.date(2024, 1, 30), n=None).count() == 2600
    assert lookups.lookup_major_events(events.withColumn("ARTICLE_COUNT", F.lit(30.0)), F.lit(True), n=None).count() == 2600
    assert lookups.lookup_event_count(events, F.lit(True), ["GBR", "USA"]).first()[0] == 2600
    assert embedding.pending_embeddings(events.withColumn("EMBEDDING", F.lit(None).cast("array<double>"))).count() == 2600
    assert stories.process_stories(events, iso, 600).count() == 600
    feed = spark.createDataFrame([("g", 20240130120000, ",".join(f"CODE_{i}_{'X' * 30}" for i in range(40)) + ",TERROR,TERROR_ATTACK")],
                                 "GKG_ID string, DATE long, TOP_THEMES string")
    topics = emotions.trending_topics(feed, dt.datetime(2024, 1, 30, 23)).collect()
    assert [(r.label, r.mentions) for r in topics] == [("Security", 2)]
