"""Texts that need a vector, and batched embedding with a pluggable embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from presswire.functions import fixed_values as V
from presswire.functions.keywords import embedding_text

# texts of one batch -> one vector per text
Embedder = Callable[[list[str]], Sequence[Sequence[float] | None]]


def pending_embeddings(
    events: DataFrame, min_articles: int = V.EMBED_MIN_ARTICLES, n: int | None = None
) -> DataFrame:
    """Reported events with a headline, enough text and no vector; with `n` the newest of them.

    Events whose text is too short to embed are left out first, so they never take a place
    of those that can be embedded.
    """
    text = embedding_text(F.col("MAIN_ACTOR"), F.col("ACTOR_COUNTRY_CODE"), F.col("HEADLINE"))
    waiting = events.filter(
        F.col("EMBEDDING").isNull()
        & (F.col("ARTICLE_COUNT") >= min_articles)
        & F.col("HEADLINE").isNotNull()
        & text.isNotNull()
    ).select("EVENT_ID", "DATE", "MAIN_ACTOR", "ACTOR_COUNTRY_CODE", "HEADLINE")
    if n is None:
        return waiting
    return waiting.orderBy(F.col("DATE").desc_nulls_last(), F.col("EVENT_ID")).limit(n)


def embedding_inputs(pending: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Event ids with the text to embed, NULL where there is too little of it."""
    text = embedding_text(F.col("MAIN_ACTOR"), F.col("ACTOR_COUNTRY_CODE"), F.col("HEADLINE"), max_chars)
    return pending.select("EVENT_ID", text.alias("text"))


def embed_batch(
    inputs: DataFrame,
    embedder: Embedder,
    batch: int = V.EMBED_BATCH,
    min_chars: int = V.EMBED_MIN_CHARS_STORED,
    max_chars: int | None = None,
) -> DataFrame:
    """(EVENT_ID, EMBEDDING) for a table of (EVENT_ID, text).

    Partitions are embedded in parallel, `batch` texts per call. Short texts and batches
    whose call fails get NULL and stay pending.
    """

    def embed(texts: list[str | None]) -> list[list[float] | None]:
        out: list[list[float] | None] = [None] * len(texts)
        usable = [
            (i, t.strip()[:max_chars])
            for i, t in enumerate(texts)
            if isinstance(t, str) and len(t.strip()) >= min_chars
        ]
        if usable:
            try:
                vectors = embedder([t for _, t in usable])
            except Exception:  # an unreachable service leaves the batch pending
                return out
            for (i, _), vector in zip(usable, vectors):
                out[i] = None if vector is None else [float(v) for v in vector]
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                yield pd.DataFrame(
                    {"EVENT_ID": part["EVENT_ID"].tolist(), "EMBEDDING": embed(part["text"].tolist())}
                )

    return inputs.select("EVENT_ID", "text").mapInPandas(run, "EVENT_ID string, EMBEDDING array<double>")
