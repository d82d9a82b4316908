"""Appends by the key index: one row per key, whatever its day, batch or interruption."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from presswire.session import work_path
from presswire.sources import key_index, tables

ROW = "EVENT_ID string, DATE string, n int"


def load(spark, path, rows):
    return sorted((tuple(r) for r in tables.append_new(
        spark.createDataFrame(rows, ROW), path, "EVENT_ID", "DATE").select("EVENT_ID", "DATE", "n").collect()), key=str)


def folder(path):
    return f"{path.removeprefix('file:')}/{key_index.FOLDER}"


def test_a_key_under_two_days_is_stored_once(spark):
    path = work_path(spark, "t")
    load(spark, path, [("a", "20240103", 1), (None, "20240103", 2), ("b", None, 3)])
    assert load(spark, path, [("a", "20240102", 4), ("a", "20240109", 5), (None, "20240101", 6), ("b", "20240101", 7),
                              ("c", "20240101", 8)]) == sorted(
        [("a", "20240103", 1), (None, "20240103", 2), ("b", None, 3), ("c", "20240101", 8)], key=str)


def test_a_load_that_stopped_between_rows_and_keys_adds_nothing_twice(spark):
    path = work_path(spark, "t")
    load(spark, path, [("a", "20240103", 1)])
    index = key_index.KeyIndex(spark, path, "EVENT_ID", "DATE")
    index.open()
    spark.createDataFrame([("b", "20240104", 2)], ROW).write.mode("append").partitionBy("DATE").parquet(path)
    assert load(spark, path, [("b", "20240105", 3), ("c", "20240105", 4)]) == [
        ("a", "20240103", 1), ("b", "20240104", 2), ("c", "20240105", 4)]
    assert not [n for n in os.listdir(folder(path)) if n.startswith("open-")]


def test_a_table_without_index_gets_one(spark):
    path = work_path(spark, "t")
    spark.createDataFrame([("a", "20240103", 1), ("b", None, 2)], ROW).write.partitionBy("DATE").parquet(path)
    assert load(spark, path, [("a", "20240102", 3), ("b", "20240102", 4)]) == [("a", "20240103", 1), ("b", None, 2)]


def test_many_loads_are_joined(spark, monkeypatch):
    monkeypatch.setattr(key_index, "MOST_LOADS", 2)
    path = work_path(spark, "t")
    for i in range(6):
        stored = load(spark, path, [(f"k{j}", f"2024010{i + 1}", i) for j in range(i + 1)])
    assert stored == [(f"k{i}", f"2024010{i + 1}", i) for i in range(6)]
    assert len([n for n in os.listdir(folder(path)) if n.startswith("load=")]) <= 4


def test_keys_of_dropped_days_may_come_again(spark):
    path = work_path(spark, "t")
    kind = "EVENT_ID string, DATE_KEY string"
    tables.append_new(spark.createDataFrame([("a", "20240101"), ("b", "20240131")], kind), path, "EVENT_ID", "DATE_KEY")
    import datetime as dt
    assert tables.drop_old_days(spark, path, dt.date(2024, 1, 31), 5) == 1
    again = tables.append_new(spark.createDataFrame([("a", "20240131"), ("b", "20240130")], kind), path, "EVENT_ID", "DATE_KEY")
    assert sorted(tuple(r) for r in again.select("EVENT_ID", "DATE_KEY").collect()) == [("a", "20240131"), ("b", "20240131")]


def test_the_look_up_reads_keys_only(spark):
    path = work_path(spark, "t")
    load(spark, path, [("a", "20240103", 1)])
    asked = spark.createDataFrame([("a",), ("z",)], "_known string")
    found = key_index.KeyIndex(spark, path, "EVENT_ID", "DATE").found(asked)
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<key:string>" in text and "DATE=" not in text
    assert [r[0] for r in found.collect()] == ["a"]


@pytest.mark.parametrize("batches", [1, 3])
def test_the_cut_into_batches_does_not_multiply_keys(spark, batches):
    rows = [(f"k{i % 40}", f"202401{i % 28 + 1:02d}", i) for i in range(400)]
    path = work_path(spark, "t")
    for b in range(batches):
        stored = load(spark, path, rows[b::batches])
    assert sorted(r[0] for r in stored) == sorted(f"k{i}" for i in range(40))


def test_wide_columns_of_known_rows_are_not_built(spark):
    path = work_path(spark, "t")
    load(spark, path, [("a", "20240103", 1)])
    rows = spark.createDataFrame([("a", "20240103", "no number"), ("b", "20240104", "2"), ("c", "20240104", "3"),
                                  ("c", "20240105", "4")], "EVENT_ID string, DATE string, n string")
    batch = rows.select("EVENT_ID", "DATE", F.col("n").cast("int").alias("n"))  # fails if it is worked out for the first row
    for _ in range(2):
        stored = tables.append_new(batch, path, "EVENT_ID", "DATE").select("EVENT_ID", "DATE", "n").collect()
        assert sorted(map(tuple, stored)) == [("a", "20240103", 1), ("b", "20240104", 2), ("c", "20240105", 4)]
    keys = key_index.KeyIndex(spark, path, "EVENT_ID", "DATE").stored().collect()
    assert sorted(map(tuple, keys)) == [("a", "20240103"), ("b", "20240104"), ("c", "20240105")]


def test_rows_that_repeat_and_null_or_empty_keys_keep_one_row(spark):
    rows = [(None, "20240101", 1), (None, "20240102", 2), ("", "20240101", 3), ("", None, 4), ("a", None, 5), ("a", None, 5)]
    path = work_path(spark, "t")
    kept = sorted([(None, "20240102", 2), ("", "20240101", 3), ("a", None, 5)], key=str)
    assert load(spark, path, rows) == kept == load(spark, path, rows)
    keys = key_index.KeyIndex(spark, path, "EVENT_ID", "DATE").stored().collect()
    assert sorted(map(tuple, keys), key=str) == sorted([(k, d) for k, d, _ in kept], key=str)


def test_an_append_reads_its_keys_once(spark):
    path, seen = work_path(spark, "t"), spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    load(spark, path, [("a", "20240103", 1)])
    rows = [(f"k{i}", "20240104", i) for i in range(50)]
    batch = spark.createDataFrame(rows, ROW).mapInPandas(count, ROW)
    assert tables.append_new(batch, path, "EVENT_ID", "DATE").count() == 51
    # once for the keys, once for the rows: a write to the table must not make the keys anew
    assert seen.value == 100
    index = key_index.KeyIndex(spark, path, "EVENT_ID", "DATE")
    assert sorted(r.key for r in index.stored().collect()) == sorted(["a", *[r[0] for r in rows]])
    assert key_index.STAGED not in os.listdir(folder(path))


def test_keys_left_by_a_stopped_load_are_not_known(spark):
    path = work_path(spark, "t")
    index = key_index.KeyIndex(spark, path, "EVENT_ID", "DATE")
    more = spark.createDataFrame([("a", "20240103", 1), (None, "20240103", 2)], ROW)
    index.stage(tables.unseen_keys(more, "EVENT_ID", "DATE"))
    assert load(spark, path, [("a", "20240104", 1), (None, "20240104", 2)]) == [("a", "20240104", 1), (None, "20240104", 2)]
    assert key_index.STAGED not in os.listdir(folder(path))
