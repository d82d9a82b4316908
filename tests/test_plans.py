"""Physical plans: what is pushed down, what is shuffled, where Python runs."""

import pytest
from pyspark.sql import functions as F

from presswire.operators import dashboard, ingest, marts, search
from presswire.plans import registry as R
from presswire.session import work_path
from presswire.sources import tables

NATIVE = ["extract_headlines", "clean_headlines", "headline_quality_by_day", "dedupe_stories", "parse_gkg",
          "fct_daily_events", "dim_countries", "process_stories", "merged_search", "keyword_search", "present_events",
          "country_alias", "label_events", "query_terms", "dq_report", "trending_topics"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    text = plan(R.QUERIES[name](spark, sf_dir))
    for bad in ("EvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text


def test_week_queries_prune_partitions(spark, sf_dir):
    path = work_path(spark, "events")
    stored = tables.append_new_events(R.without_vector(R.events_raw(spark, sf_dir)), path)
    text = plan(dashboard.tone_distribution(stored, R.AS_OF))
    assert "PartitionFilters: [isnotnull(DATE" in text and "20240123" in text
    assert "ReadSchema: struct<IMPACT_SCORE:double>" in text


def test_adapter_bound_reaches_the_scan(spark, sf_dir):
    assert "GreaterThanOrEqual(ts,2024-01-23" in plan(dashboard.weekly_metrics(R.week(spark, sf_dir), R.AS_OF))


def test_dedupe_cuts_groups_before_the_shuffle(spark, sf_dir):
    text = plan(R.QUERIES["dedupe_stories"](spark, sf_dir))
    assert text.index("WindowGroupLimit") < text.index("Exchange hashpartitioning") < text.rindex("WindowGroupLimit")


def test_best_row_combines_before_one_shuffle(spark, sf_dir):
    text = plan(ingest.extract_headlines(R.articles_raw(spark, sf_dir, wide=False)))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_min" in text


def test_actor_ranks_use_no_global_window(spark, sf_dir):
    text = plan(marts.actor_stats(R.staged(spark, sf_dir)))
    assert "Window" not in text and "Exchange SinglePartition" not in text
    ranked = plan(R.QUERIES["dim_actors"](spark, sf_dir))
    windows = [line for line in ranked.splitlines() if "+- Window " in line]
    # the only windows add up row counts per partition
    assert windows and all("[sum(_n" in line and "_part" in line for line in windows)


def test_search_top_n_carries_keys_only(spark, sf_dir):
    found = search.vector_search(R.vector_events(spark, sf_dir), R.request(spark, sf_dir), cap=2000)
    text = plan(found)
    assert "limit=2000" not in plan(R.QUERIES["vector_search"](spark, sf_dir))
    top = [line for line in text.splitlines() if "TakeOrderedAndProject(limit=2000" in line]
    assert top and all("EMBEDDING" not in line for line in top)


def test_quality_report_is_one_scan(spark, sf_dir):
    assert plan(R.QUERIES["dq_report"](spark, sf_dir)).count("FileScan") == 1


def test_new_rows_read_only_recent_days(spark, sf_dir):
    path = work_path(spark, "events")
    stored = tables.append_new_events(R.without_vector(R.events_raw(spark, sf_dir)), path)
    batch = R.without_vector(R.week(spark, sf_dir))
    text = plan(tables.new_rows_only(batch.filter(F.col("DATE") >= "20240129"), stored, "EVENT_ID", "DATE"))
    # every stored day from the batch's earliest one on, and none before
    assert "PartitionFilters: [isnotnull(DATE" in text and ">= 20240129)" in text


def test_marts_hash_and_story_span_is_read_once(spark, sf_dir):
    for name in ("fct_daily_events", "dim_countries"):
        text = plan(R.QUERIES[name](spark, sf_dir))
        assert "SortAggregate" not in text
        # distinct counts expand the cube, never the events below it
        assert text.count("Expand") == 1 and "partial_count" in text[text.index("Expand"):]
    assert plan(R.QUERIES["story_score"](spark, sf_dir)).count("+- Subquery") == 1


def test_stories_are_cleaned_once(spark, sf_dir):
    shown = R.QUERIES["process_stories"](spark, sf_dir)
    shown.collect()
    final = plan(shown).split("== Initial Plan ==")[0]
    # the day range reads the exchange that the stories themselves go through
    assert plan(shown).count("ReusedExchange") >= 1 and "SinglePartition" in final


def test_length_of_the_question_is_a_subquery(spark, sf_dir):
    text = plan(R.QUERIES["vector_search"](spark, sf_dir))
    scored = [line for line in text.splitlines() if "aggregate(EMBEDDING" in line]
    assert scored and all("* Subquery" in line for line in scored)
