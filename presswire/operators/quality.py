"""Data-quality gates.

A suite is a list of expectations; `dq_report` evaluates all of them in one aggregate
pass and unpivots the single result row.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from presswire.functions.numeric import round_half_away

_REPORT = (
    "expectation string, column string, success boolean, observed double, "
    "lower_bound double, upper_bound double, reason string, fails_batch boolean"
)
_MISSING = "Column does not exist"


@dataclass(frozen=True)
class Expectation:
    kind: str
    column: str | None = None
    lower: float | None = None
    upper: float | None = None
    min_share: float = 0.99


def column_exists(column: str) -> Expectation:
    return Expectation("column_exists", column)


def not_null_ratio(column: str, threshold: float = 0.95) -> Expectation:
    return Expectation("not_null_ratio", column, lower=threshold)


def unique(column: str) -> Expectation:
    return Expectation("unique", column)


def between(column: str, lower: float, upper: float, min_share: float = 0.99) -> Expectation:
    return Expectation("between", column, lower, upper, min_share)


def row_count(lower: int, upper: int) -> Expectation:
    return Expectation("row_count", None, lower, upper)


EVENT_SUITE = [
    column_exists("EVENT_ID"),
    column_exists("DATE"),
    column_exists("MAIN_ACTOR"),
    not_null_ratio("EVENT_ID", 1.0),
    not_null_ratio("DATE", 1.0),
    row_count(100, 50_000),
    between("IMPACT_SCORE", -10.0, 10.0),
    between("SENTIMENT_SCORE", -100.0, 100.0),
]


def _measure(e: Expectation) -> Column:
    """The one aggregate an expectation needs."""
    if e.kind == "not_null_ratio":
        return F.avg(F.col(e.column).isNotNull().cast("int"))
    if e.kind == "unique":
        has_null = F.coalesce(F.max(F.col(e.column).isNull().cast("int")), F.lit(0))
        distinct = F.count_distinct(F.col(e.column)) + has_null
        return (F.count(F.lit(1)) - distinct).cast("double")
    if e.kind == "between":
        return F.avg(F.col(e.column).between(e.lower, e.upper).cast("int"))
    return F.count(F.lit(1)).cast("double")


def _verdict(e: Expectation, present: bool, observed: Column) -> Column:
    """Report struct of one expectation."""
    fails = e.kind in ("column_exists", "not_null_ratio", "row_count")
    reason = F.lit(None)
    if e.kind == "column_exists":
        success, observed = F.lit(present), F.lit(float(present))
    elif not present:
        success, observed, reason = F.lit(False), F.lit(None), F.lit(_MISSING)
        fails = e.kind != "between"
    elif e.kind == "not_null_ratio":
        success = F.coalesce(observed >= e.lower, F.lit(False))
        observed = round_half_away(observed, 4)
    elif e.kind == "unique":
        success = observed == 0
    elif e.kind == "between":
        success = F.coalesce(observed >= e.min_share, F.lit(True))
        reason = F.when(observed.isNull(), F.lit("No non-null values to check"))
        observed = round_half_away(observed, 4)
    else:
        success = observed.between(e.lower, e.upper)
    return F.struct(
        F.lit(e.kind).alias("expectation"),
        F.lit(e.column).cast("string").alias("column"),
        success.alias("success"),
        observed.cast("double").alias("observed"),
        F.lit(e.lower).cast("double").alias("lower_bound"),
        F.lit(e.upper).cast("double").alias("upper_bound"),
        reason.cast("string").alias("reason"),
        F.lit(fails).alias("fails_batch"),
    )


def dq_report(df: DataFrame, suite: list[Expectation] = EVENT_SUITE) -> DataFrame:
    """One row per expectation, from one pass over `df`."""
    present = [e.column is None or e.column in df.columns for e in suite]
    measured = {
        i: f"m{i}" for i, e in enumerate(suite) if present[i] and e.kind != "column_exists"
    }
    values = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[_measure(suite[i]).alias(name) for i, name in measured.items()],
    )
    verdicts = [
        _verdict(e, present[i], F.col(measured[i]) if i in measured else F.lit(None))
        for i, e in enumerate(suite)
    ]
    return values.select(F.inline(F.array(*verdicts)))


def dq_summary(report: DataFrame) -> DataFrame:
    """Evaluated, successful and failed expectations and the overall verdict."""
    return report.agg(
        F.count(F.lit(1)).alias("evaluated"),
        F.count_if("success").alias("successful"),
        F.count_if(~F.col("success")).alias("unsuccessful"),
        F.bool_and(F.col("success") | ~F.col("fails_batch")).alias("passed"),
    )


# -- model tests: offending rows ----------------------------------------------

def duplicate_keys(df: DataFrame, *columns: str) -> DataFrame:
    """Non-null keys that occur more than once, with their number of rows."""
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return df.filter(known).groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def null_rows(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def unexpected_values(df: DataFrame, column: str, accepted: list[str]) -> DataFrame:
    """Values outside the accepted list, with their number of rows."""
    return (
        df.filter(~F.col(column).isin(accepted))
        .groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
    )


def negative_article_days(daily_events: DataFrame) -> DataFrame:
    return daily_events.filter(F.col("total_articles") < 0)


def model_tests(
    df: DataFrame,
    model: str,
    unique: tuple[str, ...] = (),
    not_null: tuple[str, ...] = (),
    accepted: dict[str, list[str]] | None = None,
    not_negative: tuple[str, ...] = (),
) -> DataFrame:
    """(model, test, column, failures) of the tests declared for a model, in one aggregate pass.

    A uniqueness failure is a row beyond the first of its key; NULL keys are left to `not_null`.
    """
    tests = [("unique", c, F.count(c) - F.count_distinct(c)) for c in unique]
    tests += [("not_null", c, F.count_if(F.col(c).isNull())) for c in not_null]
    tests += [("accepted_values", c, F.count_if(~F.col(c).isin(v))) for c, v in (accepted or {}).items()]
    tests += [("not_negative", c, F.count_if(F.col(c) < 0)) for c in not_negative]
    counts = df.agg(*[failures.alias(f"_{i}") for i, (_, _, failures) in enumerate(tests)])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(model).alias("model"), F.lit(test).alias("test"), F.lit(column).alias("column"),
                 F.col(f"_{i}").cast("bigint").alias("failures"))
        for i, (test, column, _) in enumerate(tests)
    ])))


def freshness(
    df: DataFrame,
    loaded_at: Column,
    as_of: dt.datetime,
    warn: dt.timedelta = dt.timedelta(hours=1),
    error: dt.timedelta = dt.timedelta(hours=3),
) -> DataFrame:
    """Newest load time against `as_of`: `pass`, `warn` or `error`; no rows is an error."""
    newest = df.agg(F.max(loaded_at.cast("timestamp_ntz")).alias("newest"))
    lag = F.timestamp_diff("SECOND", F.col("newest"), F.lit(as_of).cast("timestamp_ntz"))
    return newest.select(
        F.date_format("newest", "yyyyMMddHHmmss").alias("newest"),
        lag.alias("lag_seconds"),
        F.when(F.col("newest").isNull() | (lag > int(error.total_seconds())), "error")
        .when(lag > int(warn.total_seconds()), "warn")
        .otherwise("pass")
        .alias("status"),
    )
