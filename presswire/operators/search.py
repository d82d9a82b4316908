"""Keyword, vector and merged search over event headlines.

A search request is one question: its text and, when there is one, its vector. Requests
come from callers, so they are plan parameters (literals or scalar subqueries), and a search
is a filter, a top-n and a scoring projection. Nothing is joined with every event.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from presswire import schemas
from presswire.functions import fixed_values as V
from presswire.functions import headlines, labels
from presswire.functions.keywords import query_keywords
from presswire.functions.vectors import cosine_similarity, norm
from presswire.operators.cleaning import drop_poor_headlines, keep_first, with_accepted
from presswire.operators.countries import country_name

HIT_COLUMNS = [
    "DATE", "HEADLINE", "ACTOR_COUNTRY_CODE", "MAIN_ACTOR", "IMPACT_SCORE", "ARTICLE_COUNT",
    "NEWS_LINK", "similarity",
]
_MIN_HEADLINE = 15


@dataclass(frozen=True)
class SearchRequest:
    """A question; `vector` is a list of numbers, a scalar column or None."""

    query_id: int
    text: str
    vector: Sequence[float] | Column | None = None

    def vector_column(self) -> Column | None:
        if self.vector is None or isinstance(self.vector, Column):
            return self.vector
        return F.lit([float(v) for v in self.vector])


def query_terms(questions: DataFrame, text_col: str) -> DataFrame:
    """One row per question and search term, with the term's position."""
    others = [c for c in questions.columns if c != text_col]
    return questions.select(
        *others, F.posexplode(query_keywords(F.col(text_col))).alias("position", "term")
    )


def keywords_of(spark: SparkSession, text: str) -> list[str]:
    """Search terms of one question."""
    return spark.range(1).select(query_keywords(F.lit(text))).first()[0]


def searchable(events: DataFrame, min_date: str | None) -> DataFrame:
    found = events.filter(F.length("HEADLINE") > _MIN_HEADLINE)
    return found if min_date is None else found.filter(F.col("DATE") >= min_date)


def _contains_any(terms: Sequence[str]) -> Column:
    lowered = F.lower("HEADLINE")
    return reduce(lambda a, b: a | b, [lowered.contains(t) for t in terms])


def _most_reported(events: DataFrame, cap: int | None) -> DataFrame:
    """The `cap` events with most articles; None keeps all.

    The top-n runs on keys alone. At most `cap` keys are broadcast to fetch the wide rows,
    so vectors never travel through the top-n.
    """
    if cap is None:
        return events
    keys = (
        events.select("DATE", "EVENT_ID", "ARTICLE_COUNT")
        .orderBy(F.col("ARTICLE_COUNT").desc_nulls_last(), F.col("EVENT_ID"))
        .limit(cap)
        .select("DATE", "EVENT_ID")
    )
    return events.join(F.broadcast(keys), ["DATE", "EVENT_ID"], "left_semi")


def similarity_group(scored: DataFrame, threshold: float = V.SIMILARITY_THRESHOLD) -> DataFrame:
    """One row per headline: largest values, summed articles, best similarity at or above
    the threshold. A zero vector has no similarity and drops out."""
    return (
        scored.groupBy("HEADLINE")
        .agg(
            *[F.max(c).alias(c) for c in
              ("DATE", "ACTOR_COUNTRY_CODE", "MAIN_ACTOR", "IMPACT_SCORE", "NEWS_LINK", "similarity")],
            F.sum("ARTICLE_COUNT").alias("ARTICLE_COUNT"),
        )
        .filter(F.col("similarity") >= threshold)
        .select(*HIT_COLUMNS)
    )


def _top(hits: DataFrame, k: int | None) -> DataFrame:
    return hits if k is None else hits.orderBy(F.col("similarity").desc(), F.col("HEADLINE")).limit(k)


def _rank_by_vector(events: DataFrame, request: SearchRequest, k: int | None, cap: int | None) -> DataFrame:
    candidates = _most_reported(events.filter(F.col("EMBEDDING").isNotNull()), cap)
    asked = candidates.withColumn("_query", request.vector_column())
    # a subquery of one row: the question's length is worked out once, not per event
    question = events.sparkSession.range(1).select(request.vector_column().alias("_query"))
    length = question.select(norm(F.col("_query"))).scalar()
    scored = asked.withColumn("similarity", cosine_similarity(F.col("EMBEDDING"), F.col("_query"), length))
    return _top(similarity_group(scored), k)


def hybrid_search(
    events: DataFrame,
    request: SearchRequest,
    k: int | None = 10,
    min_date: str | None = None,
    cap: int | None = None,
) -> DataFrame:
    """Events whose headline holds any search term, ranked by similarity."""
    terms = keywords_of(events.sparkSession, request.text)
    matching = _contains_any(terms) if terms else F.lit(False)
    return _rank_by_vector(searchable(events, min_date).filter(matching), request, k, cap)


def vector_search(
    events: DataFrame,
    request: SearchRequest,
    k: int | None = 10,
    min_date: str | None = None,
    cap: int | None = None,
) -> DataFrame:
    """Events with at least two articles, ranked by similarity."""
    reported = searchable(events, min_date).filter(F.col("ARTICLE_COUNT") >= V.MIN_ARTICLES_FOR_SEARCH)
    return _rank_by_vector(reported, request, k, cap)


def dedupe_best_similarity(hits: DataFrame, first: Column | None = None) -> DataFrame:
    """Most similar hit per headline; equal ones are resolved by `first`."""
    order = [F.col("similarity").desc_nulls_last(), *([] if first is None else [first]), F.col("DATE").desc()]
    return keep_first(hits, [F.col("HEADLINE")], order)


def merged_search(
    events: DataFrame,
    request: SearchRequest,
    k: int | None = 10,
    min_date: str | None = None,
    cap: int | None = None,
) -> DataFrame:
    """Best hit per headline of hybrid and vector search."""
    both = (
        hybrid_search(events, request, k, min_date, cap).withColumn("_branch", F.lit(0))
        .unionByName(vector_search(events, request, k, min_date, cap).withColumn("_branch", F.lit(1)))
    )
    return _top(dedupe_best_similarity(both, F.col("_branch")).select(*HIT_COLUMNS), k)


def keyword_search(
    events: DataFrame, request: SearchRequest, k: int | None = 10, min_date: str | None = None
) -> DataFrame:
    """Events by number of matching search terms, then by articles; no vectors used."""
    terms = keywords_of(events.sparkSession, request.text)
    lowered = F.lower("HEADLINE")
    score = reduce(lambda a, b: a + b, [lowered.contains(t).cast("int") for t in terms], F.lit(0))
    found = (
        searchable(events, min_date)
        .withColumn("_score", score)
        .filter(F.col("_score") > 0)
        .select("EVENT_ID", *HIT_COLUMNS[:-1], F.lit(None).cast("double").alias("similarity"), "_score")
    )
    if k is not None:
        order = [F.col("_score").desc(), F.col("ARTICLE_COUNT").desc_nulls_last(), F.col("EVENT_ID")]
        found = found.orderBy(*order).limit(k)
    return found.select(*HIT_COLUMNS)


def search_with_fallback(
    events: DataFrame, request: SearchRequest, k: int | None = 10, min_date: str | None = None,
    cap: int | None = None,
) -> DataFrame:
    """Merged search; keyword search when there is no vector or nothing was found."""
    words_only = keyword_search(events, request, k, min_date)
    if request.vector is None:
        return words_only
    found = merged_search(events, request, k, min_date, cap)
    return found.unionByName(words_only.filter(~found.select("HEADLINE").exists()))


def request_vectors(spark: SparkSession, requests: Sequence[SearchRequest]) -> list[list[float] | None]:
    """Vectors of the requests; those given as scalar columns are read in one small query."""
    columns = {i: r.vector for i, r in enumerate(requests) if isinstance(r.vector, Column)}
    row = spark.range(1).select(*[c.alias(f"_{i}") for i, c in columns.items()]).first() if columns else {}
    return [row[f"_{i}"] if i in columns else r.vector for i, r in enumerate(requests)]


def score_pairs(
    candidates: DataFrame,
    requests: Sequence[SearchRequest],
    threshold: float = V.SIMILARITY_THRESHOLD,
    k: int | None = None,
) -> DataFrame:
    """Similarity of each candidate to the requests it is similar to.

    Bulk scoring: each Arrow batch of candidate vectors is one matrix product with the
    request vectors, and only pairs at or above the threshold leave the task; with `k`, of a
    batch only those as similar to a request as its k-th (ties included), which is all that
    `top_pairs` needs. Zero vectors and vectors of another length have no similarity.
    """
    vectors = request_vectors(candidates.sparkSession, requests)
    asked = [(r.query_id, v) for r, v in zip(requests, vectors) if v is not None and any(v)]
    ids = np.array([i for i, _ in asked], dtype="int64")
    matrix = np.array([v for _, v in asked], dtype="float64")
    matrix = (matrix / np.linalg.norm(matrix, axis=1, keepdims=True)).T if asked else matrix

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            rows = np.stack(frame["EMBEDDING"].to_numpy())
            lengths = np.linalg.norm(rows, axis=1, keepdims=True)
            with np.errstate(divide="ignore", invalid="ignore"):
                similarity = (rows @ matrix) / lengths
            near = similarity >= threshold
            if k is not None and k < len(rows):
                kept = np.where(near, similarity, -np.inf)
                near &= kept >= np.partition(kept, len(rows) - k, axis=0)[len(rows) - k]
            row, column = np.nonzero(near)
            yield pd.DataFrame({
                "EVENT_ID": frame["EVENT_ID"].to_numpy()[row],
                "query_id": ids[column],
                "similarity": similarity[row, column],
            })

    schema = "EVENT_ID string, query_id bigint, similarity double"
    if not asked:
        return candidates.sparkSession.createDataFrame([], schema)
    usable = candidates.filter(F.size("EMBEDDING") == matrix.shape[0])
    return usable.select("EVENT_ID", "EMBEDDING").mapInPandas(score, schema)


def top_pairs(pairs: DataFrame, k: int = 10) -> DataFrame:
    """The `k` most similar candidates of each request; cut before the shuffle as well."""
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), F.col("EVENT_ID"))
    return pairs.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def answer_context(hits: DataFrame, iso: DataFrame, n: int = 8) -> DataFrame:
    """Per request the first `n` usable hits as `[Mon DD] headline — country [severity]` lines."""
    clean = with_accepted(hits, "HEADLINE", headlines.clean_headline(F.col("HEADLINE")))
    usable = drop_poor_headlines(clean).filter(
        (F.length("HEADLINE") >= 15)
        & (headlines.garbage_words(F.col("HEADLINE")) < 2)
    )
    named = country_name(usable, "ACTOR_COUNTRY_CODE", iso, "_country")
    day = F.coalesce(F.date_format(schemas.event_day(F.col("DATE")), "MMM dd"), F.col("DATE"))
    severity = labels.severity_tag(F.col("IMPACT_SCORE"))
    line = F.concat_ws(
        " ",
        F.concat(F.lit("["), day, F.lit("]")),
        F.col("HEADLINE"),
        F.concat(F.lit("— "), F.col("_country")),
        F.when(severity != "", F.concat(F.lit("["), severity, F.lit("]"))),
    )
    order = [
        F.col("similarity").desc_nulls_last(), F.col("ARTICLE_COUNT").desc_nulls_last(), F.col("HEADLINE"),
    ]
    distinct = keep_first(named.withColumn("_line", line), [F.col("query_id"), F.col("HEADLINE")], order)
    position = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return (
        distinct.withColumn("_pos", position)
        .filter(F.col("_pos") <= n)
        .groupBy("query_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("_pos", "_line"))).alias("_lines"),
            F.count(F.lit(1)).alias("n_lines"),
        )
        .select("query_id", F.array_join(F.col("_lines._line"), "\n").alias("context"), "n_lines")
    )
