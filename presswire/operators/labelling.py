"""Events with all their labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from presswire.functions import labels
from presswire.operators.countries import region_label


def label_events(events: DataFrame, iso: DataFrame) -> DataFrame:
    score = F.col("IMPACT_SCORE")
    return region_label(events, iso).withColumns(
        {
            "IMPACT_LABEL": labels.impact_label(score),
            "INTENSITY": labels.intensity_label(score),
            "TONE": labels.tone_flag(score),
            "SEVERITY": labels.severity_tag(score),
            "SENTIMENT_CATEGORY": labels.sentiment_category(score),
        }
    )


def label_distribution(labelled: DataFrame, label: str = "INTENSITY") -> DataFrame:
    """Events per day and label."""
    return labelled.groupBy("DATE", F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("events"))
