"""Labels for scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from presswire.functions import fixed_values as V


def banded(score: Column, bands: list[tuple]) -> Column:
    """Label of the first band whose upper bound holds; NULL takes the open band."""
    *bounded, (_, _, open_label) = bands
    (first_bound, first_incl, first_label), *rest = bounded

    def below(bound: float, inclusive: bool) -> Column:
        return score <= F.lit(float(bound)) if inclusive else score < F.lit(float(bound))

    chain = reduce(
        lambda acc, b: acc.when(below(b[0], b[1]), F.lit(b[2])),
        rest,
        F.when(below(first_bound, first_incl), F.lit(first_label)),
    )
    return chain.otherwise(F.lit(open_label))


def _known(score: Column, labelled: Column, unknown: str) -> Column:
    return F.when(score.isNull() | F.isnan(score), F.lit(unknown)).otherwise(labelled)


def impact_label(score: Column) -> Column:
    return _known(score, banded(score, V.IMPACT_BANDS), V.IMPACT_UNKNOWN)


def intensity_label(score: Column) -> Column:
    return _known(score, banded(score, V.INTENSITY_BANDS), V.INTENSITY_UNKNOWN)


def sentiment_category(score: Column) -> Column:
    """Five-way bucket; a missing score falls into the last one."""
    return banded(score, V.SENTIMENT_BANDS)


def tone_flag(score: Column) -> Column:
    flag = (
        F.when(score < -4, V.TONE_RED)
        .when(score < -1, V.TONE_AMBER)
        .when(score > 2, V.TONE_GREEN)
        .otherwise(V.TONE_WHITE)
    )
    return _known(score, flag, V.TONE_WHITE)


def severity_tag(score: Column) -> Column:
    tag = (
        F.when(score <= -7, "severe crisis")
        .when(score <= -4, "crisis")
        .when(score <= -2, "negative")
        .when(score >= 5, "positive")
        .otherwise("")
    )
    return _known(score, tag, "")


def sentiment_status(average: Column) -> Column:
    """Weekly status of an average impact; no data counts as zero."""
    return banded(F.coalesce(average, F.lit(0.0)), V.WEEKLY_STATUS_BANDS)


def mood_label(mood: Column) -> Column:
    return banded(F.coalesce(mood, F.lit(0.0)), V.MOOD_BANDS)


def dominant_emotion(columns: dict[str, Column]) -> Column:
    """First emotion, in the given order, that equals the greatest one."""
    top = F.greatest(*columns.values())
    return F.coalesce(*[F.when(top == column, F.lit(name)) for name, column in columns.items()])
