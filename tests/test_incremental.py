"""Marts kept up by days: equal to a full build after any loads, and untouched days stay as they are."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from presswire.operators import marts
from presswire.operators.staging import stg_emotions, stg_events
from presswire.plans import registry as R
from presswire.plans.incremental import MartStore
from presswire.session import work_path
from presswire.sources import tables
from presswire.sources.day_ledger import DayLedger

EVENT_MARTS = {
    "fct_daily_events": marts.fct_daily_events, "dim_actors": marts.dim_actors, "dim_countries": marts.dim_countries}
EMOTION_MARTS = {
    "fct_daily_emotions": marts.fct_daily_emotions,
    "fct_trending_themes": lambda staged: marts.fct_trending_themes(staged, n=None)}


def rows(df):
    """All rows, floats without the noise of summation order."""
    return sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()], key=repr)


def same_as_full(store, event_marts=EVENT_MARTS, emotion_marts=EMOTION_MARTS):
    for name, build in event_marts.items():
        full = build(stg_events(tables.read_events(store.spark, store.events_path)))
        assert store.mart(name).schema.simpleString() == full.schema.simpleString()
        assert rows(store.mart(name)) == rows(full), name
    for name, build in emotion_marts.items():
        assert rows(store.mart(name)) == rows(build(stg_emotions(tables.read_gkg(store.spark, store.gkg_path)))), name


@pytest.fixture
def store(spark):
    root = work_path(spark, "store")
    return MartStore(spark, f"{root}/marts", f"{root}/events", f"{root}/gkg")


def files(store, name):
    top = f"{store.root}/{name}".removeprefix("file:")
    return {d: sorted(os.listdir(f"{top}/{d}")) for d in os.listdir(top) if "=" in d}


def test_only_touched_days_are_written(spark, sf_dir, store):
    events = R.vector_events(spark, sf_dir).filter(F.col("DATE") < "20240106")
    odd = F.col("EVENT_ID").cast("bigint") % 2 == 1
    tables.append_new_events(events.filter(odd), store.events_path)
    assert store.refresh_events() is None
    before = files(store, "event_cube")
    late = events.filter(~odd & (F.col("DATE") == "20240102"))
    tables.append_new_events(late.unionByName(events.filter(odd)), store.events_path)
    assert store.refresh_events() == ["20240102"]
    after = files(store, "event_cube")
    assert {d for d in after if after[d] != before.get(d)} == {"event_date_raw=20240102"}
    assert store.refresh_events() == []
    same_as_full(store, emotion_marts={})
    # stored vectors change a day as well
    vectors = events.filter(odd & (F.col("DATE") == "20240103")).select("EVENT_ID", "DATE", F.array(F.lit(1.0)).alias("EMBEDDING"))
    tables.write_embeddings(spark, store.events_path, vectors)
    assert store.refresh_events() == ["20240103"]
    same_as_full(store, emotion_marts={})


def test_days_past_retention_leave_the_marts(spark, sf_dir, store):
    emotion_rows = R.gkg(spark, sf_dir)
    tables.append_new_gkg(emotion_rows.filter(F.col("DATE") < 20240105000000), store.gkg_path)
    store.refresh_emotions()
    more = emotion_rows.filter((F.col("DATE") >= 20240105000000) & (F.col("DATE") < 20240107000000))
    tables.append_new_gkg(more, store.gkg_path, dt.date(2024, 2, 2))
    assert set(store.refresh_emotions()) == {"20240101", "20240102", "20240105", "20240106"}
    assert {r.date_key for r in store.mart("fct_daily_emotions").collect()} == {"20240103", "20240104", "20240105", "20240106"}
    same_as_full(store, event_marts={})


def test_a_load_that_stopped_is_worked_on_until_another_ends_it(spark, sf_dir, store):
    events = R.vector_events(spark, sf_dir).filter(F.col("DATE") < "20240104")
    odd = F.col("EVENT_ID").cast("bigint") % 2 == 1
    tables.append_new_events(events.filter(odd), store.events_path)
    store.refresh_events()
    ledger = DayLedger(spark, store.events_path)
    ledger.note(events.filter(F.col("DATE") == "20240102"), "DATE")  # and no end
    assert store.refresh_events() == ["20240102"] == store.refresh_events()
    tables.append_new_events(events.filter(~odd & (F.col("DATE") == "20240103")), store.events_path)
    assert sorted(store.refresh_events()) == ["20240102", "20240103"]
    assert store.refresh_events() == []
    same_as_full(store, emotion_marts={})


def test_a_refresh_that_stopped_is_made_good(spark, sf_dir, store, monkeypatch):
    events = R.vector_events(spark, sf_dir).filter(F.col("DATE") < "20240104")
    odd = F.col("EVENT_ID").cast("bigint") % 2 == 1
    tables.append_new_events(events.filter(odd), store.events_path)
    store.refresh_events()
    tables.append_new_events(events, store.events_path)

    def stop(_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as broken:
        broken.setattr(marts, "dim_countries", stop)
        with pytest.raises(RuntimeError):
            store.refresh_events()
    assert sorted(store.refresh_events()) == ["20240101", "20240102", "20240103"]
    same_as_full(store, emotion_marts={})


def test_null_days_and_empty_tables(spark, sf_dir, store):
    store.refresh()
    assert store.mart("dim_actors").count() == 0 == store.mart("fct_daily_emotions").count()
    events = R.vector_events(spark, sf_dir).filter(F.col("DATE") < "20240103")
    nameless = F.when(F.col("EVENT_ID").cast("bigint") % 4 > 0, F.col("DATE"))
    tables.append_new_events(events.withColumn("DATE", nameless), store.events_path)
    assert None in store.refresh_events()
    same_as_full(store, emotion_marts={})


def test_both_dimensions_come_from_stored_cells(spark, store, monkeypatch):
    rows_of = [("1", "20240101", "A", "USA"), ("2", "20240101", "A", None), ("3", "20240102", None, "USA"),
               ("4", "20240102", "A", "USA"), ("5", None, None, None), ("6", None, "B", "FRA"), ("7", "odd", "B", "USA")]
    events = spark.createDataFrame(rows_of, "EVENT_ID string, DATE string, MAIN_ACTOR string, ACTOR_COUNTRY_CODE string")
    measures = {"ARTICLE_COUNT": F.col("EVENT_ID").cast("double"), "IMPACT_SCORE": F.when(F.col("EVENT_ID") != "6", -1.0)}
    tables.append_new_events(events.withColumns(measures), store.events_path)
    given, build = [], marts.dim_countries
    with monkeypatch.context() as watched:
        watched.setattr(marts, "dim_countries", lambda df: given.append(df.columns) or build(df))
        store.refresh_events()
    assert "cell_days" in given[0]
    same_as_full(store, emotion_marts={})
